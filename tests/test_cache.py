"""Token caches: versions that are switched as a whole, and what is refused."""

import os

import pytest
from pyspark.sql import functions as F

from strideflow.sources import cache, shared

GOOD = {k: "0" * 64 for k in cache.DIGESTS}


def content(spark, shift=0, lengths=((1, "b", 9), (0, "a", 4), (2, "c", 1))):
    tokens = [(s, k, (17 * p + k + shift) % 256) for p, s, n in lengths for k in range(-(-n // 4))]
    return spark.createDataFrame(tokens, "sequence_id string, k long, token_id long"), spark.createDataFrame(lengths, "place long, sequence_id string, frames long")


def current(spark, root):
    return sorted((r.sequence_id, r.k, r.token_id) for r in cache.read(spark, root)[1].collect())


def test_round_trip_offsets_and_statistics(spark, tmp_path):
    tokens, lengths = content(spark)
    cache.write(tokens, lengths, str(tmp_path / "c"), GOOD)
    sequences, held = cache.read(spark, str(tmp_path / "c"), GOOD)
    assert [(r.sequence_id, r.tokens, r.padding, r.offset_start, r.offset_end) for r in sequences.orderBy("place").collect()] == [("a", 1, 0, 0, 1), ("b", 3, 3, 1, 4), ("c", 1, 3, 4, 5)]
    marks = cache.statistics_tokens(sequences, held).orderBy("offset").collect()
    assert [(r.offset, r.in_statistics) for r in marks] == [(0, True), (1, True), (2, True), (3, False), (4, False)]


def test_versions_are_replaced_and_rolled_back(spark, tmp_path):
    root = str(tmp_path / "c")
    cache.write(*content(spark), root, GOOD)
    old = current(spark, root)
    with pytest.raises(cache.CacheError, match="there is a cache"):
        cache.write(*content(spark, 1), root, GOOD)
    cache.write(*content(spark, 1), root, GOOD | {"split_sha256": "1" * 64}, replace=True)
    assert current(spark, root) != old
    with pytest.raises(cache.CacheError, match="other artefacts: split_sha256"):
        cache.read(spark, root, GOOD)
    cache.rollback(spark, root)
    assert current(spark, root) == old
    cache.read(spark, root, GOOD)
    cache.rollback(spark, root)  # undoes the rollback
    assert current(spark, root) != old


def test_a_write_that_fails_half_way_leaves_the_old_cache(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "c")
    cache.write(*content(spark), root, GOOD)
    old = current(spark, root)
    tokens, lengths = content(spark, 1)
    dies = tokens.withColumn("token_id", F.when(F.col("sequence_id") == "b", F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("token_id")))
    with pytest.raises(Exception, match="lost"):
        cache.write(dies, lengths, root, GOOD, replace=True)
    assert current(spark, root) == old
    monkeypatch.setattr(cache, "commit", lambda *a: (_ for _ in ()).throw(OSError("no entry")))  # everything is staged, the entry is not written
    with pytest.raises(OSError, match="no entry"):
        cache.write(tokens, lengths, root, GOOD, replace=True)
    assert current(spark, root) == old
    monkeypatch.undo()
    os.makedirs(f"{root}/log/000000000001/_temporary/0/task")  # an entry that a writer began
    with open(f"{root}/log/000000000001/_temporary/0/task/part-0.txt", "w") as f:
        f.write("{")
    assert current(spark, root) == old
    assert shared.committed(spark, f"{root}/log/000000000001") is None


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        (lambda t, n: (t.withColumn("token_id", F.lit(256)), n), "token_range: 3"),
        (lambda t, n: (t.withColumn("token_id", F.lit(None).cast("long")), n), "token_range: 3"),
        (lambda t, n: (t.where("NOT (sequence_id = 'b' AND k = 1)"), n), "length: 1"),
        (lambda t, n: (t.withColumn("k", F.col("k") + 1), n), "position: 3"),
        (lambda t, n: (t, n.where("sequence_id <> 'c'")), "unknown_sequence: 1"),
        (lambda t, n: (t.replace("c", ""), n.replace("c", "")), "blank_id: 1"),
        (lambda t, n: (t, n.union(n.sparkSession.createDataFrame([(3, "a", 4)], n.schema))), "repeated_id: 1"),
        (lambda t, n: (t, n.withColumn("frames", F.when(F.col("sequence_id") == "a", 0).otherwise(F.col("frames")))), "frames: 1"),
    ],
)
def test_content_that_breaks_the_contract_is_refused(spark, tmp_path, change, reason):
    root = str(tmp_path / "c")
    with pytest.raises(cache.CacheError, match=reason):
        cache.write(*change(*content(spark)), root, GOOD)
    with pytest.raises(cache.CacheError, match="no cache"):
        cache.read(spark, root)


@pytest.mark.parametrize("odd", [{"input_fps": 30}, {"codebook_size": True}, {"extra": 1}, {"tokenizer_sha256": "A" * 64}, {"schema_sha256": "0" * 63}])
def test_manifests_are_strict(odd):
    with pytest.raises(cache.CacheError, match=next(iter(odd))):
        cache.checked(GOOD | odd)
    with pytest.raises(cache.CacheError, match="split_sha256"):
        cache.checked({k: v for k, v in GOOD.items() if k != "split_sha256"})
