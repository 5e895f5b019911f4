"""Corpora on disk: the writer's layout and reports, a write that dies, and the window scan against a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideflow.sources import corpus
from strideflow.sources.sinks import checksums, file_digest


def tables(spark, lengths, seed=0):
    """Sequences s0, s1, … of these lengths: the records and frames of two sides, three channels and one, and the arrays themselves."""
    rng = np.random.default_rng(seed)
    data = {f"s{k:03d}": rng.normal(k, 2, (n, 4)).astype(np.float32) for k, n in enumerate(lengths)}
    split = {s: "val" if k % 5 == 4 else "train" for k, s in enumerate(data)}
    records = spark.createDataFrame([(s, split[s], f"d{k % 2}", ["t"] if k % 3 == 0 else [], float(k)) for k, s in enumerate(data)], "sample_id string, split string, source_dataset string, texts array<string>, score double")
    rows = [(s, t, [float(x) for x in f[:3]], [float(f[3])]) for s, v in data.items() for t, f in enumerate(v)]
    random.Random(seed).shuffle(rows)
    return records, spark.createDataFrame(rows, "sample_id string, t long, human array<float>, g1 array<float>").repartition(4), data, split


def no_rejects(spark):
    return spark.createDataFrame([("bad", "d0", "quality", "x"), ("worse", None, "shape", None)], "sample_id string, source_dataset string, reason string, detail string")


def reference_window(data, names, number, size, stride, mean, std):
    """The window of a number, by walking the sequences."""
    counts = [max(1, -(-max(0, len(data[s]) - size) // stride) + 1) for s in names]
    if number < 0:
        number += sum(counts)
    if not 0 <= number < sum(counts):
        return None
    k = 0
    while number >= counts[k]:
        number, k = number - counts[k], k + 1
    start = number * stride
    part = (data[names[k]][start : start + size, :3].astype(float) - mean) / std
    kept = len(part)
    if not kept:
        return names[k], start, None, None, None
    frames = np.concatenate([part, np.repeat(part[-1:], size - kept, 0)]).astype(np.float32)
    mask = np.arange(size) < kept
    return names[k], start, frames, mask, mask.reshape(-1, 4).all(1)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    keep = corpus.BLOCK, corpus.BUCKET
    corpus.BLOCK, corpus.BUCKET = 16, 7  # windows over several blocks, sequences over several buckets
    records, frames, data, split = tables(spark, [5, 40, 1, 130, 16, 17, 33, 64, 20, 2])
    root = str(tmp_path_factory.mktemp("corpus") / "c")
    marker = corpus.write(records.unionByName(records.limit(1).withColumn("sample_id", F.lit("zz-lost"))), frames, no_rejects(spark), root, {"human": 3, "g1": 1}, 100, {"g1": [0]}, 20.0, ["score"])
    yield corpus.Corpus(spark, root), marker, data, split, root, frames, records
    corpus.BLOCK, corpus.BUCKET = keep


def test_layout_and_reports(stored, spark):
    c, marker, data, split, root, _, _ = stored
    assert c.differences() == [] and marker["frames"] == sum(map(len, data.values())) and marker["sequences"] == len(data)
    for name in ("train", "val"):
        rows = sorted(c.sequences(name).collect())
        assert [r.sample_id for r in rows] == sorted(s for s in data if split[s] == name)
        last = {}
        for r in rows:
            assert r.frame_start == last.get(r.shard, 0) and r.frame_end - r.frame_start == len(data[r.sample_id])
            last[r.shard] = r.frame_end
        assert all(x <= 100 or sum(r.shard == k for r in rows) == 1 for k, x in last.items())
    held = c.blocks().where("sample_id = 's003'").orderBy("block").collect()
    np.testing.assert_array_equal(np.concatenate([np.array(r.human, np.float32) for r in held]), data["s003"][:, :3])
    train = np.concatenate([data[s] for s in data if split[s] == "train"]).astype(float)
    n = c.report("normalizers")
    np.testing.assert_allclose(n["human"]["mean"], train[:, :3].mean(0), rtol=1e-6)
    np.testing.assert_allclose(n["human"]["std"], train[:, :3].std(0), rtol=1e-6)
    assert (n["g1"]["mean"], n["g1"]["std"]) == ([0.0], [1.0])
    assert c.report("failures_by_reason") == {"no_frames": 1, "quality": 1, "shape": 1}
    sources = c.report("source_statistics")
    assert sources["d0"]["accepted"] == 5 and sources["d0"]["failures_by_reason"] == {"no_frames": 1, "quality": 1} and sources["d1"]["quality_metrics"]["score"]["max"] == 9.0
    assert c.report("summary")["captioned_sequences"] == 4 and c.report("schema")["human"]["shape"] == "[T,3]"
    accepted = spark.read.json(f"{root}/manifest/accepted")
    assert accepted.count() == len(data) and {"prepared_frames", "texts", "split"} <= set(accepted.columns)
    assert spark.read.json(f"{root}/manifest/split_assignment").count() == spark.read.json(f"{root}/texts/annotations").count() == len(data)
    inventory = {r.path: r.sha256 for r in spark.read.parquet(f"{root}/checksums").collect()}
    assert any(p.startswith("shards/split=train/shard=0/") for p in inventory)
    assert all(file_digest(f"{root}/{p}") == h for p, h in inventory.items())


@pytest.mark.parametrize(("size", "stride"), [(16, 8), (8, 8), (20, 3), (4, 9), (196, 64)])
@pytest.mark.parametrize("normalised", [True, False])
def test_windows_match_a_plain_loop(stored, spark, size, stride, normalised):
    c, _, data, split, _, _, _ = stored
    names = sorted(s for s in data if split[s] == "train")
    norm = c.report("normalizers")["human"] if normalised else None
    mean, std = (np.array(norm["mean"]), np.array(norm["std"])) if norm else (0.0, 1.0)
    numbers = [*range(-90, 120), 3, 3]
    got = {r.number: r for r in c.windows(spark.createDataFrame([(n,) for n in numbers], "n long"), "train", "human", size, stride, norm).collect()}
    assert set(got) == set(numbers)
    for n in set(numbers):
        expected, r = reference_window(data, names, n, size, stride, mean, std), got[n]
        if expected is None:
            assert r.reason == "index" and r.frames is None
            continue
        if expected[2] is None:
            assert (r.sample_id, r.start, r.reason, r.frames) == (*expected[:2], "empty", None)
            continue
        assert (r.sample_id, r.start, r.reason) == (*expected[:2], None)
        np.testing.assert_allclose(np.array(r.frames), expected[2], atol=1e-6)
        assert r.frame_mask == list(expected[3]) and r.token_mask == list(expected[4])


def test_scan_is_pruned_and_has_no_nested_loop(stored, spark):
    w = stored[0].windows(spark.range(1), "val", "g1", 16, 8)
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "(split#" in plan.split("PartitionFilters")[1].split("]")[0] + plan and " = val)" in plan and "shard#" in plan and " = 0)" in plan


def test_refusals(stored, spark, tmp_path):
    c, _, _, _, root, frames, records = stored
    with pytest.raises(ValueError, match="empty corpus split"):
        c.windows(spark.range(1), "test", "human", 16, 8)
    with pytest.raises(ValueError, match="whole tokens"):
        c.windows(spark.range(1), "train", "human", 15, 8)
    with pytest.raises(Exception, match="already exists"):
        corpus.write(records, frames, no_rejects(spark), root, {"human": 3, "g1": 1})
    with pytest.raises(ValueError, match="unique"):
        corpus.write(records.union(records), frames, no_rejects(spark), str(tmp_path / "twice"), {"human": 3, "g1": 1})
    with pytest.raises(ValueError, match="train frames"):
        corpus.write(records.withColumn("split", F.lit("val")), frames, no_rejects(spark), str(tmp_path / "val"), {"human": 3, "g1": 1})


def test_a_write_that_dies_is_not_readable(stored, spark, tmp_path):
    frames, records = stored[5:]
    broken = frames.withColumn("g1", F.when((F.col("sample_id") == "s007") & (F.col("t") == 60), F.raise_error(F.lit("lost")).cast("array<float>")).otherwise(F.col("g1")))
    root = str(tmp_path / "dies")
    with pytest.raises(Exception, match="lost"):
        corpus.write(records, broken, no_rejects(spark), root, {"human": 3, "g1": 1}, 100)
    with pytest.raises(ValueError, match="no committed corpus"):
        corpus.Corpus(spark, root)


def test_offsets_that_do_not_fit_fail_the_read(stored, spark, tmp_path):
    import shutil

    root = str(tmp_path / "copy")
    shutil.copytree(stored[4], root)
    spark.read.parquet(f"{stored[4]}/offsets").where("NOT (split = 'val' AND position = 1)").write.mode("overwrite").partitionBy("split").parquet(f"{root}/offsets")
    with pytest.raises(Exception, match="offsets do not fit"):
        corpus.Corpus(spark, root).sequences("val").collect()


def test_checksums_of_many_small_files_and_a_large_one(spark, tmp_path):
    import hashlib

    (tmp_path / "x y" / "z").mkdir(parents=True)
    expected = {}
    for k in range(40):
        p = tmp_path / "x y" / f"f{k}.bin"
        p.write_bytes(bytes([k]) * k)
        expected[f"x y/f{k}.bin"] = hashlib.sha256(bytes([k]) * k).hexdigest()
    large, size = tmp_path / "x y" / "z" / "large.bin", (1 << 31) + 12345  # beyond what one row can hold; a sparse file
    with large.open("wb") as f:
        f.truncate(size)
        f.seek(size - 3)
        f.write(b"end")
    own = hashlib.sha256()
    for _ in range(size // (1 << 20)):
        own.update(bytes(1 << 20))
    own.update((bytes(size % (1 << 20) - 3)) + b"end")
    expected["x y/z/large.bin"] = own.hexdigest()
    got = {r.path: (r.length, r.sha256) for r in checksums(spark, str(tmp_path)).collect()}
    assert {k: v[1] for k, v in got.items()} == expected and got["x y/z/large.bin"][0] == size


def test_inventory_of_all_tables(spark, data):
    import os

    import __spark_entry__

    found = [os.path.join(at, n) for at, _, names in os.walk(data) for n in names if not n.startswith(("_", "."))]
    got = {(r.path, r.length, r.sha256) for r in __spark_entry__.queries()["checksum_inventory"](spark, data).collect()}
    assert got == {(os.path.relpath(p, data), os.path.getsize(p), file_digest(p)) for p in found} and len(got) >= 14


def test_folders_do_not_grow_with_the_shards_of_a_small_cap(spark, tmp_path, monkeypatch):
    """A folder holds as many shards as make up SHARD_FRAMES frames; a sequence longer than the cap is cut into files of that many."""
    monkeypatch.setattr(corpus.C, "SHARD_FRAMES", 100)
    monkeypatch.setattr(corpus, "BLOCK", 8)
    records, frames, data, split = tables(spark, [9] * 60 + [260, 12, 7])
    root = str(tmp_path / "c")
    corpus.write(records, frames, no_rejects(spark), root, {"human": 3, "g1": 1}, 20)
    c = corpus.Corpus(spark, root)
    shards = {(r.split, r.shard) for r in c.blocks().select("split", "shard").distinct().collect()}
    folders = {tuple(x.split("=")[1] for x in r.path.split("/")[1:3]) for r in spark.read.parquet(f"{root}/checksums").where("path LIKE 'shards/%'").collect()}
    assert folders == {(s, str(k // 5 * 5)) for s, k in shards} and len(folders) < 10 < 30 < len(shards)
    assert c.differences() == [] and len(spark.read.parquet(f"{root}/shards").where("sample_id = 's060'").select(F.input_file_name()).distinct().collect()) <= 3
    for s in ("train", "val"):
        place = {r.sample_id: (r.shard, r.position) for r in c.sequences(s).collect()}
        held = c.blocks().where(F.col("split") == s).orderBy("block").collect()
        for name in (x for x in data if split[x] == s):
            own = [r for r in held if r.sample_id == name]
            assert {(r.shard, r.position) for r in own} == {place[name]} and all(r.folder == r.shard // 5 * 5 for r in own)
            np.testing.assert_array_equal(np.concatenate([np.array(r.human, np.float32) for r in own]), data[name][:, :3])
