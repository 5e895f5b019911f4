"""Streams that own their state and prefixes that grow: reasons, restarts, history and expiry."""

import time

import numpy as np

from strideflow.streaming import owned

CHUNK = "sample_id long, seq long, owner string, generation long, kind string, values array<double>, mask array<boolean>"
PAIR = "sample_id long, seq long, kind string, human long, robot long"


def run(spark, at, schema, output, make, batches):
    """A query that is started anew for each batch of rows, or of tables."""
    for k, rows in enumerate(batches):
        (rows if hasattr(rows, "write") else spark.createDataFrame(rows, schema)).write.parquet(f"{at}/in/part={k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/in")
        make(stream).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema(output).parquet(f"{at}/out").collect()


def frames(key, seq, generation, values, owner="me", mask=None):
    return (key, seq, owner, generation, "frames", values, [True] * len(values) if mask is None else mask)


def token():
    """Made here, so that it is sent by value: workers do not import this module."""
    return lambda x: int(x.sum())


def test_chunks_match_the_whole_sequence_whatever_the_cuts(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = {k: rng.integers(0, 9, 30).astype(float) for k in range(6)}
    batches = [[], [], []]
    for k, v in data.items():
        cuts = sorted(rng.integers(0, 31, 5).tolist())
        for g, (a, b) in enumerate(zip([0, *cuts], [*cuts, 30], strict=True)):  # some are empty
            batches[g // 2].append(frames(k, g, g, v[a:b].tolist()))
    for b in batches:
        rng.shuffle(b)
    got = run(spark, tmp_path, CHUNK, owned.TOKENS, lambda s: owned.encode_chunks(s, "me", token(), 6), [[tuple(r[:1]) + (int(r[1]), r[2], int(r[3]), *r[4:]) for r in map(tuple, b)] for b in batches])
    assert all(r.reason is None for r in got)
    expected = {(k, j): int(v[max(0, 4 * j - 6) : 4 * j + 4].sum()) for k, v in data.items() for j in range(7)}
    assert {(r.sample_id, r.k): r.token_id for r in got} == expected and len(got) == len(expected)


def test_states_that_do_not_fit_are_refused_and_change_nothing(spark, tmp_path):
    first = [frames(1, 0, 0, [1.0] * 6), frames(1, 1, 0, [9.0] * 8), frames(1, 2, 1, [9.0] * 8, "you"), frames(1, 3, 5, [9.0] * 8), frames(1, 4, 1, [9.0], mask=[True, True]), frames(1, 5, 1, [float("nan")]), frames(1, 6, 1, [float("nan"), 2.0], mask=[False, True])]
    second = [frames(1, 7, 1, [9.0] * 4), (1, 8, "you", 2, "reset", None, None), (1, 9, "me", 2, "reset", None, None), frames(1, 10, 2, [9.0] * 4), (1, 11, "me", 2, "reset", None, None), frames(1, 12, 3, [5.0] * 4), (1, 13, "me", 4, "frames", None, None), frames(2, 0, 0, [])]
    got = run(spark, tmp_path, CHUNK, owned.TOKENS, lambda s: owned.encode_chunks(s, "me", token()), [first, second])
    assert sorted(r.reason for r in got if r.reason) == sorted(["consumed", "foreign", "unknown", "mask", "nonfinite", "consumed", "foreign", "reset", "reset", "mask"])
    tokens = sorted((r.generation, r.k, r.token_id, r.token_mask) for r in got if not r.reason)
    assert tokens == [(0, 0, 4, True), (1, 1, 4, True), (3, 0, 20, True)]  # 1 1 (masked 0) 2; then anew after the reset


def test_an_unused_state_expires(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a query with expiry never runs out of batches
    try:
        make = lambda s: owned.encode_chunks(s, "me", token(), 0, ttl_ms=3_000)
        run(spark, tmp_path, CHUNK, owned.TOKENS, make, [[frames(1, 0, 0, [1.0] * 4)]])
        time.sleep(5)
        spark.createDataFrame([frames(1, 1, 1, [1.0] * 4)], CHUNK).write.parquet(f"{tmp_path}/in/part=9")
        stream = spark.readStream.schema(CHUNK).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        make(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = spark.read.schema(owned.TOKENS).parquet(f"{tmp_path}/out").collect()
    assert sorted((r.generation, r.reason) for r in got) == [(0, None), (1, "unknown")]


def test_prefixes_grow_and_refusals_are_counted(spark, tmp_path):
    first = [(1, 0, "snapshot", None, None), (1, 2, "pair", 0, 255), (1, 1, "pair", 256, 3), (1, 3, "pair", 4, None), (2, 0, "pair", -1, 0)]
    second = [(1, 3, "pair", 5, 6), (1, 2, "pair", 5, 6), (1, 9, "snapshot", None, None), (2, 1, "snapshot", None, None)]
    got = {(r.sample_id, r.seq, r.place, r.human, r.robot, tuple(r.human_prefix or ()), tuple(r.robot_prefix or ()), r.refused, r.reason) for r in run(spark, tmp_path, PAIR, owned.PREFIXES, owned.grow_prefixes, [first, second])}
    assert got == {
        (1, 0, 0, None, None, (), (), 0, "empty"), (1, 1, None, None, None, (), (), 1, "human_range"), (1, 2, 0, 0, 255, (), (), 1, None), (1, 3, None, None, None, (), (), 2, "robot_range"), (2, 0, None, None, None, (), (), 1, "human_range"),
        (1, 2, None, None, None, (), (), 3, "late"), (1, 3, 1, 5, 6, (), (), 3, None), (1, 9, 2, None, None, (0, 5), (255, 6), 3, None), (2, 1, 0, None, None, (), (), 1, "empty"),
    }


def test_state_grows_by_one_element_a_pair():
    """The processor appends; it neither reads nor rewrites the list."""

    class Handle:
        def __init__(self):
            self.calls, self.value = [], None

        def getListState(self, *a):
            return self

        def getValueState(self, *a):
            return type("V", (), {"exists": lambda s: self.value is not None, "get": lambda s: self.value, "update": lambda s, v: setattr(self, "value", v)})()

        def appendValue(self, v):
            self.calls.append(v)

    import pandas as pd

    p, h = owned.Prefixes(256), Handle()
    p.init(h)
    for k in range(50):
        list(p.handleInputRows((1,), iter([pd.DataFrame([(1, k, "pair", k, k)], columns=["sample_id", "seq", "kind", "human", "robot"])]), None))
    assert h.calls == [(k, k) for k in range(50)] and h.value == (50, 0, 49)
