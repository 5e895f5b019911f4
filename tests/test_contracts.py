"""Every rule of the contracts is broken once, and kept once."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strideflow.operators import contracts as K
from strideflow.operators.frames import windowed


def reasons(spark, reason, schema, *rows):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(reason).collect()]


def test_sequences(spark):
    got = reasons(
        spark, K.sequence_reason(F.col("v"), 2, F.col("m"), 2), "v array<double>, m array<boolean>",
        ([1.0] * 4, [True, False]), (None, None), ([], []), ([1.0] * 3, [True]), ([1.0] * 2, [True]), ([1.0, float("nan"), 1.0, 1.0], [True, True]), ([1.0, 1.0, float("-inf"), 1.0], [True, True]),
        ([1.0, None, 1.0, 1.0], [True, True]), ([1.0] * 4, [True]), ([1.0] * 4, [False, False]), ([1.0] * 4, [True, None]), ([1.0] * 4, None),
    )
    assert got == [None, "shape", "shape", "width", "alignment", "finite", "finite", "finite", "mask_shape", "mask_empty", "mask_empty", "mask_shape"]
    both = reasons(spark, K.reconstruction_reason(F.col("a"), F.col("b"), F.col("m"), 1), "a array<double>, b array<double>, m array<boolean>", ([1.0], [2.0], [True]), ([1.0], [2.0, 1.0], [True]), ([1.0], [float("inf")], [True]))
    assert both == [None, "shape", "finite"]


def test_timelines(spark):
    rows = ([0.0, 1.0],), ([0.0],), (None,), ([],), ([0.0, 0.0],), ([1.0, 0.0],), ([0.0, float("nan")],)
    assert reasons(spark, K.timeline_reason(F.col("t"), 2), "t array<double>", *rows) == [None, "length", "length", "length", "order", "order", "finite"]
    assert reasons(spark, K.timeline_reason(F.col("t")), "t array<double>", ([3.0],), ([],)) == [None, "length"]


def test_settings(spark):
    assert reasons(spark, K.window_reason(F.col("a"), F.col("b")), "a int, b int", (196, 64), (0, 4), (8, 6), (None, 4)) == [None, "dimension", "alignment", "alignment"]
    token = reasons(spark, K.tokenizer_reason(F.col("k"), F.col("f"), F.col("n"), F.col("c"), "human"), "k string, f double, n int, c int", ("human", 20.0, 4, 256), ("g1", 20.0, 4, 256), ("human", 25.0, 4, 256), ("human", 20.0, 2, 256), ("human", 20.0, 4, 512))
    assert token == [None, "domain", "timing", "timing", "codebook"]
    shape = reasons(spark, K.architecture_reason(*map(F.col, "wdrce"), 3), "w int, d int, r int, c int, e double", (8, 8, 3, 256, 0.99), (0, 8, 3, 256, 0.9), (8, 8, 4, 256, 0.9), (8, 8, 3, 128, 0.9), (8, 8, 3, 256, 1.0), (8, 8, 3, 256, float("nan")))
    assert shape == [None, "dimension", "depth", "codebook", "decay", "decay"]
    assert reasons(spark, K.contact_threshold_reason(F.col("h"), F.col("s")), "h double, s double", (0.06, 0.25), (0.0, 1.0), (1.0, float("inf")), (None, 1.0)) == [None, *["threshold"] * 3]
    assert reasons(spark, K.only_name(F.col("n")), "n array<string>", (["x"],), (["x", "y"],), ([],), (None,)) == ["x", None, None, None]


def test_caches(spark):
    stated = spark.createDataFrame([("a", 5, 2, 3), ("b", 4, 1, 0), ("b", 4, 1, 0), ("", 4, 1, 0), ("c", 5, 1, 0), ("d", 4, 1, 0), ("e", 4, 1, 0), ("f", 8, 2, 0), ("g", 5, 2, 0)], "sequence_id string, frames int, tokens int, padding int")
    held = spark.createDataFrame([("a", 0, 1), ("a", 1, 255), ("b", 0, 1), ("", 0, 1), ("c", 0, 1), ("e", 0, 256), ("f", 0, 1), ("f", 0, 1), ("g", 0, 1), ("g", 1, 1), ("z", 0, 1)], "sequence_id string, k int, token_id int")
    got = {r.sequence_id: r.problem for r in K.cache_problems(stated, held).collect()}
    assert got == {"b": "repeated_id", "": "blank_id", "c": "tokens", "d": "length", "e": "token_range", "f": "position", "g": "padding", "z": "unknown_sequence"}


def test_choice(spark):
    rows = spark.createDataFrame([(s, k, k / 10) for s in "ab" for k in range(50)], "stratum string, k int, seconds double")
    chosen = K.bounded_choice(rows, "stratum", "k", "seconds", 1.0, 3.0, 4, 7)
    got = [tuple(r) for r in chosen.collect()]
    assert len(got) == len(set(got)) == 8 and all(1 <= s <= 3 for *_, s in got)
    assert sorted(got) == sorted(tuple(r) for r in K.bounded_choice(rows.repartition(5), "stratum", "k", "seconds", 1.0, 3.0, 4, 7).collect())
    with pytest.raises(PySparkException, match="too few rows"):
        K.bounded_choice(rows, "stratum", "k", "seconds", 1.0, 1.2, 4, 7).collect()


def test_windows_keep_a_mask(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0, 5.0], 5, [True, False, True, True, None]), ("b", [1.0], 1, None)], "id string, values array<double>, n int, own array<boolean>")
    got = {(r.id, r.start): r.frame_mask for r in windowed(rows, 4, 4, "own").collect()}
    assert got == {("a", 0): [True, False, True, True], ("a", 4): [False] * 4, ("b", 0): [False] * 4}
    plain = {(r.id, r.start): r.frame_mask for r in windowed(rows, 4, 4).collect()}
    assert plain == {("a", 0): [True] * 4, ("a", 4): [True, False, False, False], ("b", 0): [True, False, False, False]}
