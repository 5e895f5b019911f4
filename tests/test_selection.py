"""Selected percentiles, motion signatures, captions of mixed JSON, bounded examples and rotation resampling."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideflow.functions import keys
import brute_prepare as prepare
from strideflow.operators import selection, splits, timeline


@pytest.mark.parametrize(("bins", "leaf"), [(1024, 65536), (16, 1)])
def test_percentiles_match_numpy(spark, monkeypatch, bins, leaf):
    monkeypatch.setattr(selection, "BINS", bins)
    monkeypatch.setattr(selection, "LEAF", leaf)
    rng = np.random.default_rng(1)
    data = {
        "even": rng.normal(0, 1, 300), "powers": np.concatenate([10.0 ** rng.integers(-300, 300, 100), -(10.0 ** rng.integers(-300, 300, 100))]), "ties": np.repeat([1.0, 2.0, 2.5], [200, 1, 5]), "one": np.array([7.0]),
        "two": np.array([-1.0, 3.0]), "huge": np.array([-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324]), "near": 1 + np.arange(50) * 2.0**-52,
    }
    rows = [(g, float(x)) for g, v in data.items() for x in v] + [(None, 5.0), (None, 6.0), ("even", None), ("nulls", None)]
    random.Random(0).shuffle(rows)
    shares = [0.0, 0.02, 0.5, 0.95, 1.0]
    got = {r.g: r for r in selection.percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", shares).collect()}
    assert set(got) == {*data, None} and (got[None].n, got[None].p2) == (2, 5.5)
    for g, v in data.items():
        r, s = got[g], np.sort(v)
        assert (r.n, r.minimum, r.maximum) == (len(v), s[0], s[-1])
        for k, share in enumerate(shares):
            at = share * (len(v) - 1)
            low, high = float(s[math.floor(at)]), float(s[math.ceil(at)])
            expected = low if low == high else low + (high - low) * (at - math.floor(at))
            assert r[f"p{k}"] == pytest.approx(expected, rel=1e-12, abs=0), (g, share)


def test_percentiles_hold_no_group(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
    plan = selection.percentiles(df, ["g"], "x", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower()


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 129, 200])
def test_signature_equals_the_digest_of_arrays(spark, n):
    rng = np.random.default_rng(n)
    joints = rng.normal(0, 2, (n, 5, 3)).astype(np.float32)
    joints[0, 1] = joints[0, 0] + np.float32(0.0005)  # halves of a millimetre
    df = spark.createDataFrame([([[float(x) for x in f.ravel()] for f in joints],)], "frames array<array<float>>")
    assert df.select(splits.motion_signature(F.col("frames"), 5)).first()[0] == prepare.motion_signature(joints)
    assert spark.createDataFrame([([],), (None,)], "frames array<array<float>>").select(splits.motion_signature(F.col("frames"), 5)).distinct().collect()[0][0] is None


def test_captions_of_mixed_labels(spark):
    labels = ["  plain ", "", {"proc_label": " timed ", "start_t": 1, "end_t": 2.5}, {"proc_label": "text time", "start_t": "3.5"}, {"proc_label": "bad", "start_t": "x", "end_t": 4}, {"proc_label": 12}, {"proc_label": ""}, {"start_t": 1}, 7, None, True, ["a"], {"proc_label": None}]
    rows = [(1, json.dumps(labels)), (2, "not json"), (3, None), (4, "{}"), (5, "[]")]
    got = spark.createDataFrame(rows, "k int, labels string").select("k", F.explode(keys.captions(F.col("labels"), "kind", "field")).alias("c")).select("k", "c.*").collect()
    assert [tuple(r) for r in got] == [
        (1, "plain", "kind", "field", None, None, None), (1, "timed", "kind", "field", 1.0, 2.5, None), (1, "text time", "kind", "field", 3.5, None, None), (1, "bad", "kind", "field", None, 4.0, "start_t"), (1, "12", "kind", "field", None, None, None),
    ]


def test_examples_of_leaking_groups_are_bounded(spark):
    rows = [(f"g{k:03d}", m * 1000 + k, ("train", "val", "test")[m % 3 if k % 2 else 0], f"d{m % 2}") for k in range(30) for m in range(1 if k == 4 else 12)]
    df = spark.createDataFrame(rows, "sig string, id long, split string, source string").repartition(5)
    got = sorted(splits.leakage_examples(df, "sig", "split", "source", "id").collect(), key=lambda r: r.members[0])
    shared = [k for k in range(30) if k != 4][:20]
    assert [(r.sig, r.members, r.datasets, r.final_split) for r in got] == [(f"g{k:03d}", [m * 1000 + k for m in range(10)], ["d0", "d1"], "test" if k % 2 else "train") for k in shared]
    plan = splits.leakage_examples(df, "sig", "split", "source", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "TakeOrderedAndProject" in plan


def test_rotations_match_the_kernel_and_shuffle_once(spark):
    rng = np.random.default_rng(4)
    rows, wanted, expected = [], [], {}
    for k in range(5):
        at = np.sort(rng.uniform(0, 10, 12))
        q = rng.normal(0, 1, (12, 4))
        to = np.concatenate([rng.uniform(at[0], at[-1], 20), at[[0, 5]]])
        rows += [(k, float(s), [float(x) for x in v]) for s, v in zip(at, q, strict=True)]
        wanted += [(k, float(x)) for x in to]
        unit = q / np.linalg.norm(q, axis=1, keepdims=True)
        expected |= {(k, float(x)): v for x, v in zip(to, prepare.resample_rotations(unit, at, to), strict=True)}
        wanted.append((k, float(at[-1]) + 1))
        expected[k, float(at[-1]) + 1] = unit[-1]
    points, targets = spark.createDataFrame(rows, "sample_id long, s double, rotation array<double>"), spark.createDataFrame(wanted, "sample_id long, at double")
    out = timeline.resample_rotations(points, targets, "sample_id")
    got = {(r.sample_id, r.at): r.rotation for r in out.collect()}
    assert set(got) == set(expected)
    for k, v in expected.items():
        turned = np.array(got[k])
        np.testing.assert_allclose(turned * np.sign(turned @ v), v, atol=1e-9)
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
