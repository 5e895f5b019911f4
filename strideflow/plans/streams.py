"""Queries over streams of events, each beside the SQL that states its result. A query is stopped and started again between the parts of its input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.plans.motion import SQL_FRAMES
from strideflow.sources.shared import scratch
from strideflow.sources.tables import event_frames
from strideflow.streaming import owned

CATALOGUE: dict[str, tuple] = {}


def query(sql: str):
    def add(f):
        CATALOGUE[f.__name__] = (f, f"WITH {SQL_FRAMES.strip()}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().lstrip('+')}")
        return f

    return add


def in_parts(rows: DataFrame, run, schema: str, *parts) -> DataFrame:
    """What a streaming query puts out of rows that come part by part; the query starts anew, from its checkpoint, for each."""
    spark = rows.sparkSession
    at = scratch(spark, "stream")
    for k, part in enumerate(parts):
        rows.where(part).write.parquet(f"{at}/in/part={k}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{at}/in")
        run(stream).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")


def _token(frames: np.ndarray) -> int:
    return int(np.floor(np.round(frames.sum(), 4))) % 256


@query("""+ e AS (SELECT sample_id, t, value, sample_id % 5 = 2 AND t >= 8 AS again FROM f),
    s AS (SELECT *, sum(value) OVER (w ROWS 7 PRECEDING) AS total, bool_or(t % 13 >= 4) OVER (w ROWS 3 PRECEDING) AS any_valid FROM e WINDOW w AS (PARTITION BY sample_id, again ORDER BY t))
    SELECT sample_id, t // 8 + again::INT AS generation, (t - 8 * again::INT) // 4 AS k, floor(round(total, 4))::BIGINT % 256 AS token_id, any_valid AS token_mask, NULL AS reason FROM s WHERE t % 4 = 3
    UNION ALL SELECT sample_id, 0, NULL, NULL, NULL, 'consumed' FROM n WHERE sample_id % 5 = 1 AND n > 8
    UNION ALL SELECT sample_id, 0, NULL, NULL, NULL, 'foreign' FROM n WHERE sample_id % 7 = 3
    UNION ALL SELECT sample_id, 1, NULL, NULL, NULL, 'reset' FROM n WHERE sample_id % 5 = 2
    UNION ALL SELECT sample_id, 9, NULL, NULL, NULL, 'unknown' FROM n WHERE sample_id % 11 = 4
    UNION ALL SELECT sample_id, 0, NULL, NULL, NULL, 'mask' FROM n WHERE sample_id % 3 = 0""")
def stream_ownership(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of events in chunks of eight frames, with a history of four, among rows of other owners, used, given up and unknown states and bad masks."""
    f = event_frames(spark, d).select("sample_id", F.col("t").cast("long").alias("t"), "value", F.floor(F.col("t") / 8).alias("c"))
    packed = F.sort_array(F.collect_list(F.struct("t", "value")))
    chunks = f.groupBy("sample_id", "c").agg(packed.alias("rows"))
    user = F.col("sample_id")
    good = chunks.select(
        "sample_id", "c", (F.col("c") * 10 + 5).alias("seq"), F.lit("ours").alias("owner"), (F.col("c") + F.when((user % 5 == 2) & (F.col("c") >= 1), 1).otherwise(0)).alias("generation"), F.lit("frames").alias("kind"),
        F.col("rows.value").alias("values"), F.transform("rows.t", lambda t: t % 13 >= 4).alias("mask"),
    )

    def more(which, c: int, seq: int, generation: int, owner: str = "ours", kind: str = "frames", flags: int = 1) -> DataFrame:
        one = F.array(F.lit(1.0)) if kind == "frames" else F.lit(None).cast("array<double>")
        return good.where(which & (F.col("c") == c)).select("sample_id", "c", F.lit(seq).cast("long").alias("seq"), F.lit(owner).alias("owner"), F.lit(generation).cast("long").alias("generation"), F.lit(kind).alias("kind"), one.alias("values"), F.array(*[F.lit(True)] * flags).alias("mask"))

    rows = good.union(more(user % 5 == 1, 1, 16, 0)).union(more(user % 7 == 3, 0, 0, 0, "other")).union(more(user % 5 == 2, 0, 7, 1, kind="reset")).union(more(user % 5 == 2, 0, 8, 1))
    rows = rows.union(more(user % 11 == 4, 0, 1, 9)).union(more(user % 3 == 0, 0, 2, 0, flags=2)).drop("c")
    return in_parts(rows, lambda s: owned.encode_chunks(s, "ours", _token, 4), owned.TOKENS, F.col("seq") < 12, F.col("seq") >= 12)


@query("""+ p AS (SELECT sample_id, t, floor(value)::BIGINT % 260 AS h, floor(value * 7)::BIGINT % 258 AS r, event_type = 'error' AS asks FROM f),
    q AS (SELECT *, NOT asks AND h < 256 AND r < 256 AS ok FROM p),
    c AS (SELECT *, count(*) FILTER (ok) OVER w AS upto, sum(h) FILTER (ok) OVER w AS hs, sum(r) FILTER (ok) OVER w AS rs, count(*) FILTER (NOT ok AND NOT asks) OVER w AS refused FROM q WINDOW w AS (PARTITION BY sample_id ORDER BY t))
    SELECT sample_id, t AS seq, CASE WHEN ok THEN upto - 1 WHEN asks THEN upto END AS place, CASE WHEN ok THEN h END AS human, CASE WHEN ok THEN r END AS robot,
        CASE WHEN asks AND upto > 0 THEN upto END AS prefix, CASE WHEN asks THEN hs END::BIGINT AS human_total, CASE WHEN asks THEN rs END::BIGINT AS robot_total, refused,
        CASE WHEN asks AND upto = 0 THEN 'empty' WHEN NOT asks AND h >= 256 THEN 'human_range' WHEN NOT asks AND r >= 256 THEN 'robot_range' END AS reason FROM c""")
def stream_prefixes(spark, d):
    """Pairs of tokens from events, some out of range; an error event asks for the prefix so far."""
    f = event_frames(spark, d)
    kind = F.when(F.col("event_type") == "error", "snapshot").otherwise("pair")
    rows = f.select("sample_id", F.col("t").cast("long").alias("seq"), kind.alias("kind"), (F.floor("value") % 260).alias("human"), (F.floor(F.col("value") * 7) % 258).alias("robot"))
    out = in_parts(rows, owned.grow_prefixes, owned.PREFIXES, F.col("seq") < 6, F.col("seq") >= 6)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    size = F.when(F.col("human_prefix").isNotNull(), F.size("human_prefix")).cast("long")
    return out.select("sample_id", "seq", "place", "human", "robot", size.alias("prefix"), total("human_prefix").alias("human_total"), total("robot_prefix").alias("robot_total"), "refused", "reason")
