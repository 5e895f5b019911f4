"""Queries over what is written and read again: corpora and token caches, each beside the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.operators import corpus as assembly
from strideflow.operators import frames, splits
from strideflow.plans.motion import FPS, SIZE, SQL_FRAMES, STRIDE
from strideflow.sources import cache, corpus, prepared
from strideflow.sources.shared import scratch
from strideflow.sources.tables import event_frames

CATALOGUE: dict[str, tuple] = {}
CAP = 500


def query(sql: str = ""):
    def add(f):
        CATALOGUE[f.__name__] = (f, f"WITH RECURSIVE {SQL_FRAMES.strip()}, {sql.strip()}" if sql else "")
        return f

    return add


def written(spark: SparkSession, d: str) -> corpus.Corpus:
    """Events as a corpus of two sides: a sequence for each user with at least 8 events, those with fewer are rejected."""
    f = event_frames(spark, d).withColumn("value", F.col("value").cast("float"))
    frames_ = f.select("sample_id", F.col("t").cast("long").alias("t"), F.array("value", (F.col("value") * 2).cast("float")).alias("human"), F.array("value").alias("g1"), "value", "event_type")
    users = frames_.groupBy("sample_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.max_by("event_type", "t").alias("last_type"))
    source = F.concat(F.lit("source"), (F.col("sample_id") % 3).cast("string")).alias("source_dataset")
    texts = F.when(F.col("sample_id") % 4 == 0, F.array("last_type")).otherwise(F.array().cast("array<string>")).alias("texts")
    records = users.where("n >= 8").select("sample_id", splits.stable_split(F.col("sample_id")).alias("split"), source, texts, "mean_value")
    rejected = users.where("n < 8").select("sample_id", source, F.when(F.col("n") < 4, "too_short").otherwise("short").alias("reason"), F.col("n").cast("string").alias("detail"))
    root = scratch(spark, "corpus")
    corpus.write(records, frames_.select("sample_id", "t", "human", "g1"), rejected, root, {"human": 2, "g1": 1}, CAP, {"g1": [0]}, FPS, ["mean_value"])
    return corpus.Corpus(spark, root)


SQL_SPLITS = """
    u AS (SELECT sample_id, n, CASE WHEN b < 90 THEN 'train' WHEN b < 95 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, ('0x' || substr(sha256(sample_id::VARCHAR), 1, 16))::UBIGINT % 100 AS b FROM n) WHERE n >= 8)"""


@query(f"""{SQL_SPLITS}, r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sample_id) AS i FROM u),
    p AS (SELECT split, n, i, 0::BIGINT AS shard, 0::BIGINT AS frame_start FROM r WHERE i = 1 UNION ALL
        SELECT r.split, r.n, r.i, CASE WHEN p.frame_start + p.n + r.n > {CAP} THEN p.shard + 1 ELSE p.shard END, CASE WHEN p.frame_start + p.n + r.n > {CAP} THEN 0 ELSE p.frame_start + p.n END FROM p JOIN r ON r.split = p.split AND r.i = p.i + 1)
    SELECT split, shard, count(*) AS sequences, sum(n)::BIGINT AS frames, min(frame_start) AS first_start, max(frame_start + n) AS last_end, 0::BIGINT AS gaps, true AS same FROM p GROUP BY 1, 2""")
def corpus_layout(spark, d):
    """Shards of a written corpus as they are read back; same: the blocks read have the digest and counts that the marker states."""
    c = written(spark, d)
    same = not c.differences()
    rows = None
    for split in ("train", "val", "test"):
        own = c.sequences(split).withColumn("split", F.lit(split))
        rows = own if rows is None else rows.unionByName(own)
    gaps = assembly.contiguity_audit(rows.withColumn("k", F.struct("split", "shard")), "k", "position").select("k.split", "k.shard", "gaps")
    held = c.blocks().groupBy("split", "shard").agg(F.sum("held").alias("frames"))
    out = rows.groupBy("split", "shard").agg(F.count("*").alias("sequences"), F.min("frame_start").alias("first_start"), F.max("frame_end").alias("last_end")).join(gaps, ["split", "shard"]).join(held, ["split", "shard"])
    return out.select("split", F.col("shard").cast("long").alias("shard"), "sequences", F.col("frames").cast("long").alias("frames"), "first_start", "last_end", "gaps", F.lit(same).alias("same"))


@query(f"""{SQL_SPLITS}, c AS (SELECT *, greatest(1, ceil(greatest(0, n - 16) / 8.0) + 1)::BIGINT AS windows FROM u WHERE split = 'train'),
    o AS (SELECT *, sum(windows) OVER (ORDER BY sample_id) - windows AS first, sum(windows) OVER () AS total FROM c),
    w AS (SELECT sample_id, n, first + i AS w, i * 8 AS start, total FROM (SELECT *, unnest(generate_series(0, windows - 1)) AS i FROM o)),
    q AS (SELECT r AS number, CASE WHEN r < 0 THEN r + total ELSE r END AS w, total FROM (SELECT unnest(generate_series(-(total + 1)::BIGINT, total::BIGINT)) AS r, total FROM (SELECT DISTINCT total FROM o))),
    s AS (SELECT avg(f.value::FLOAT::DOUBLE) AS mean, stddev_pop(f.value::FLOAT::DOUBLE) AS std FROM f JOIN c USING (sample_id)),
    x AS (SELECT q.number, w.sample_id, w.start, j, w.start + j < w.n AS m, ((f.value::FLOAT::DOUBLE - s.mean) / greatest(s.std, 1e-4))::FLOAT AS z
        FROM q JOIN w USING (w), s, (SELECT unnest(generate_series(0, 15)) AS j) JOIN f ON f.sample_id = w.sample_id AND f.t = least(w.start + j, w.n - 1)),
    k AS (SELECT number, j // 4 AS k, bool_and(m) AS whole FROM x GROUP BY 1, 2)
    SELECT x.number, sample_id, start, count_if(m)::BIGINT AS valid, (SELECT count_if(whole) FROM k WHERE k.number = x.number)::BIGINT AS tokens, round(sum(z::DOUBLE), 3) AS total,
        round(arg_max(z, j)::DOUBLE, 3) AS last_value, NULL AS reason FROM x GROUP BY x.number, sample_id, start
    UNION ALL SELECT number, NULL, NULL, NULL, NULL, NULL, NULL, 'index' FROM q WHERE w < 0 OR w >= total""")
def corpus_windows(spark, d):
    """Every train window of a written corpus by its number, counted from either end, with its masks and normalised frames, and the numbers next to either end that no window has."""
    c = written(spark, d)
    total = c.index("train", SIZE, STRIDE).agg(F.sum("windows")).first()[0]
    w = c.windows(spark.range(-total - 1, total + 1), "train", "human", SIZE, STRIDE, c.report("normalizers")["human"])
    first = F.transform("frames", lambda f: f[0].cast("double"))
    set_ = lambda m: F.size(F.filter(m, lambda x: x)).cast("long")
    known = F.col("reason").isNull()
    return w.select(
        "number", "sample_id", "start", F.when(known, set_("frame_mask")).alias("valid"), F.when(known, set_("token_mask")).alias("tokens"),
        F.round(F.aggregate(first, F.lit(0.0), lambda a, x: a + x), 3).alias("total"), F.round(F.element_at(first, -1), 3).alias("last_value"), "reason",
    )


@query(f"""{SQL_SPLITS}, l AS (SELECT n.sample_id, 'source' || (n.sample_id % 3) AS src, n.n, split, n.sample_id % 4 = 0 AS spoken FROM n LEFT JOIN u USING (sample_id)),
    t AS (SELECT f.value::FLOAT::DOUBLE AS v FROM f JOIN u USING (sample_id) WHERE split = 'train'),
    m AS (SELECT src, avg(f.value::FLOAT::DOUBLE) AS x FROM f JOIN l USING (sample_id) WHERE n >= 8 GROUP BY f.sample_id, src)
    SELECT 'by_split' AS report, split AS name, count(*)::DOUBLE AS value FROM u GROUP BY split
    UNION ALL SELECT 'by_dataset', src, count(*)::DOUBLE FROM l WHERE n >= 8 GROUP BY src
    UNION ALL SELECT 'failures', CASE WHEN n < 4 THEN 'too_short' ELSE 'short' END, count(*)::DOUBLE FROM l WHERE n < 8 GROUP BY 2
    UNION ALL SELECT 'coverage', 'texts', round(count_if(spoken) / count(*), 6) FROM l WHERE n >= 8
    UNION ALL SELECT 'hours', 'all', round(sum(n) / 20 / 3600, 6) FROM l WHERE n >= 8
    UNION ALL SELECT 'normalizer', unnest(['human 0 mean', 'human 0 std', 'human 1 mean', 'human 1 std', 'g1 0 mean', 'g1 0 std']),
        unnest([round(avg(v), 4), round(greatest(stddev_pop(v), 1e-4), 4), round(2 * avg(v), 4), round(greatest(2 * stddev_pop(v), 1e-4), 4), 0, 1]) FROM t
    UNION ALL SELECT 'median', src, round(median(x), 4) FROM m GROUP BY src
    UNION ALL SELECT 'p95', src, round(quantile_cont(x, 0.95), 4) FROM m GROUP BY src""")
def corpus_reports(spark, d):
    """What a written corpus reports of itself: counts, failures, captions, hours, normalisers and the spread of a metric."""
    c = written(spark, d)
    summary, sources = c.report("summary"), c.report("source_statistics")
    rows = [("by_split", k, v) for k, v in summary["by_split"].items()] + [("by_dataset", k, v) for k, v in summary["by_dataset"].items()] + [("failures", k, v) for k, v in c.report("failures_by_reason").items()]
    rows += [("coverage", "texts", round(summary["text_coverage"], 6)), ("hours", "all", round(summary["accepted_duration_hours"], 6))]
    rows += [("normalizer", f"{s} {k} {p}", round(x, 4)) for s, n in c.report("normalizers").items() for p in ("mean", "std") for k, x in enumerate(n[p])]
    rows += [(p, s, round(v["quality_metrics"]["mean_value"][p], 4)) for s, v in sources.items() for p in ("median", "p95")]
    return spark.createDataFrame([(a, b, float(v)) for a, b, v in rows], "report string, name string, value double")


def manifest(mark: str) -> dict:
    return {k: mark * 64 for k in cache.DIGESTS}


@query(f"""{SQL_SPLITS}, c AS (SELECT sample_id, n, sum(ceil(n / 4.0)::BIGINT) OVER (ORDER BY sample_id)::BIGINT AS offset_end, ceil(n / 4.0)::BIGINT AS tokens FROM u WHERE split = 'train'),
    g AS (SELECT c.sample_id, k, least(4 * k + j, n - 1) AS t FROM (SELECT *, unnest(generate_series(0, tokens - 1)) AS k FROM c) c, (SELECT unnest(generate_series(0, 3)) AS j)),
    x AS (SELECT g.sample_id, g.k, floor(round(sum(f.value::FLOAT::DOUBLE), 4))::BIGINT % 256 AS token_id FROM g JOIN f ON f.sample_id = g.sample_id AND f.t = g.t GROUP BY 1, 2)
    SELECT x.sample_id AS sequence_id, k, token_id, offset_end - tokens + k AS "offset", 4 * k + 4 <= n AS in_statistics, tokens * 4 - n AS padding FROM x JOIN c USING (sample_id)""")
def token_cache_transaction(spark, d):
    """The cache job over a written corpus, read back after a version that replaced it, one that was refused, and a rollback."""
    c, root = written(spark, d), scratch(spark, "tokens")
    total = F.aggregate(F.transform("frames", lambda f: f[0].cast("double")), F.lit(0.0), lambda a, x: a + x)
    token = F.floor(F.round(total, 4)) % 256
    cache.tokenise(c, "train", "human", token, root, manifest("a"))
    cache.tokenise(c, "train", "human", F.lit(7), root, manifest("b"), replace=True)
    try:
        cache.tokenise(c, "train", "human", token + 256, root, manifest("c"), replace=True)
    except cache.CacheError:
        cache.rollback(spark, root)
    sequences, tokens = cache.read(spark, root, manifest("a"))
    out = cache.statistics_tokens(sequences, tokens).join(sequences.select("sequence_id", "padding"), "sequence_id")
    return out.select("sequence_id", "k", F.col("token_id").cast("long").alias("token_id"), "offset", "in_statistics", "padding")


@query("""x AS (SELECT f.sample_id, n, (-n % 4 + 4) % 4 AS pad, sum(value::FLOAT::DOUBLE) AS total, arg_max(value::FLOAT::DOUBLE, t) AS last FROM f JOIN n USING (sample_id) GROUP BY 1, 2)
    SELECT sample_id::VARCHAR AS sequence_id, CASE sample_id % 6 WHEN 1 THEN 'unreadable' WHEN 3 THEN 'source_fps' WHEN 4 THEN 'source_format' WHEN 5 THEN 'nonfinite' END AS reason,
        CASE WHEN sample_id % 6 IN (0, 2) THEN n END AS valid_frames, CASE WHEN sample_id % 6 IN (0, 2) THEN n + pad END AS frames,
        CASE WHEN sample_id % 6 IN (0, 2) THEN round(total + pad * last, 3) END AS robot_total, CASE WHEN sample_id % 6 IN (0, 2) THEN round(2 * (total + pad * last), 2) END AS human_total FROM x""")
def prepared_motion(spark, d):
    """Events as prepared archives, written and read back. Of six users, one's archive is cut short, and three have a rate, a format or a feature that the contract refuses."""
    s = frames.sequence_arrays(event_frames(spark, d), "value")
    wide = lambda c, k: F.flatten(F.transform(c, lambda v: F.array_repeat(v.cast("double"), k)))
    kind = F.col("sample_id") % 6
    robot = F.when(kind == 5, F.transform("values", lambda v, i: F.when(i == 0, F.lit(float("nan"))).otherwise(v))).otherwise(F.col("values"))
    pairs = s.select(
        F.col("sample_id").cast("string").alias("sequence_id"), F.when(kind == 3, -1.0).otherwise(50.0).alias("source_fps"), F.when(kind == 4, "odd").otherwise("safe_npz").alias("source_format"),
        wide(F.transform("values", lambda v: v * 2), 262).alias("human_features"), wide(robot, 75).alias("g1_features"), wide("values", 3).alias("human_space"), wide("values", 3).alias("g1_space"),
        F.array(*[F.lit(0.0)] * 3).alias("anchor_origin"), F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)]).alias("anchor_basis"),
    )
    at = scratch(spark, "prepared")
    prepared.write(pairs, at)
    contents = spark.read.parquet(at)
    cut = F.when(F.col("sequence_id").cast("long") % 6 == 1, F.expr("substring(content, 1, 300)")).otherwise(F.col("content"))
    out = prepared.load(contents.select("sequence_id", cut.alias("content")))
    total = lambda c, w: F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x) / w
    return out.select("sequence_id", "reason", F.col("valid_frames").cast("long").alias("valid_frames"), F.col("frames").cast("long").alias("frames"), F.round(total("g1_features", 75), 3).alias("robot_total"), F.round(total("human_features", 262), 2).alias("human_total"))
