"""Queries over events as motion, each beside the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideflow import constants as C
from strideflow.operators import codebook, containers, contracts, corpus, frames, joins, metrics, quality, splits, timeline
from strideflow.sources.tables import event_frames

FPS, HOURLY = 20.0, 1.0 / 3600
SIZE, STRIDE = 16, 8

#: Events in frame order, as the queries read them.
SQL_FRAMES = """
    f AS (SELECT user_id AS sample_id, event_id, event_type, value, props, epoch_us(ts) / 1e6 - 1704067200 AS s,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events),
    v AS (SELECT *, coalesce((value - lag(value) OVER w) * 20, 0) AS vel FROM f WINDOW w AS (PARTITION BY sample_id ORDER BY t)),
    n AS (SELECT sample_id, count(*) AS n FROM f GROUP BY 1)"""

CATALOGUE: dict[str, tuple] = {}


def query(sql: str):
    """Registers a query with its SQL; `WITH` and the frame tables go before it."""

    def add(f):
        CATALOGUE[f.__name__] = (f, f"WITH {SQL_FRAMES.strip()}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().lstrip('+')}" if sql else "")
        return f

    return add


def r6(c):
    return F.round(c, 6)


def lengths(f: DataFrame) -> DataFrame:
    return f.groupBy("sample_id").agg(F.count("*").cast("int").alias("n"))


@query("SELECT sample_id, event_id, t FROM f")
def frame_index(spark: SparkSession, d: str) -> DataFrame:
    return event_frames(spark, d).select("sample_id", "event_id", F.col("t").cast("long").alias("t"))


@query("SELECT sample_id, t, round(vel, 6) AS velocity FROM v")
def causal_velocity(spark, d):
    f = event_frames(spark, d)
    return f.select("sample_id", F.col("t").cast("long").alias("t"), r6(frames.backward_difference("value", FPS)).alias("velocity"))


@query("SELECT sample_id, t, round(coalesce(lead(value) OVER w - value, value - lag(value) OVER w, 0), 6) AS displacement FROM f WINDOW w AS (PARTITION BY sample_id ORDER BY t)")
def forward_displacement_repeat_tail(spark, d):
    return event_frames(spark, d).select("sample_id", F.col("t").cast("long").alias("t"), r6(frames.forward_difference("value")).alias("displacement"))


@query("""+ i AS (SELECT sample_id, t, value, first_value(value) OVER w AS v0, sum(vel / 20) OVER w AS p FROM v WINDOW w AS (PARTITION BY sample_id ORDER BY t))
    SELECT sample_id, round(arg_max(p, t), 6) AS end_position, round(max(abs(p - (value - v0))), 6) AS max_error FROM i GROUP BY 1""")
def velocity_integration(spark, d):
    f = event_frames(spark, d).withColumn("vel", frames.backward_difference("value", FPS))
    f = f.withColumns({"p": frames.integrate("vel", FPS), "v0": F.first("value").over(frames.by_sample())})
    return f.groupBy("sample_id").agg(r6(F.max_by("p", "t")).alias("end_position"), r6(F.max(F.abs(F.col("p") - (F.col("value") - F.col("v0"))))).alias("max_error"))


@query("SELECT sample_id, unnest(generate_series(0, greatest(0, ceil((n - 16) / 8.0)::BIGINT))) * 8 AS start, n FROM n")
def strided_windows(spark, d):
    return frames.window_starts(lengths(event_frames(spark, d)), SIZE, STRIDE).select("sample_id", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n"))


@query("""+ w AS (SELECT sample_id, n, unnest(generate_series(0, greatest(0, ceil((n - 16) / 8.0)::BIGINT))) * 8 AS start FROM n),
    s AS (SELECT sample_id, n, start, unnest(generate_series(0, 15)) AS j FROM w),
    x AS (SELECT s.sample_id, s.start, j // 4 AS k, start + j < s.n AS m, f.value FROM s JOIN f ON f.sample_id = s.sample_id AND f.t = least(s.start + j, s.n - 1))
    SELECT sample_id, start, k, bool_and(m) AS in_statistics, bool_or(m) AS assigned, round(sum(value), 4) AS total FROM x GROUP BY 1, 2, 3""")
def window_masks(spark, d):
    w = frames.windowed(frames.sequence_arrays(event_frames(spark, d), "value"), SIZE, STRIDE)
    every, some = frames.token_masks()
    tokens = w.select("sample_id", "start", "frames", F.posexplode(F.arrays_zip(every.alias("e"), some.alias("s"))).alias("k", "m"))
    total = F.aggregate(F.slice("frames", F.col("k") * 4 + 1, 4), F.lit(0.0), lambda a, x: a + x)
    return tokens.select("sample_id", F.col("start").cast("long").alias("start"), F.col("k").cast("long").alias("k"), F.col("m.e").alias("in_statistics"), F.col("m.s").alias("assigned"), F.round(total, 4).alias("total"))


@query("SELECT sample_id, n, greatest(1, ceil(greatest(0, n - 16) / 8.0) + 1)::BIGINT AS windows FROM n")
def window_count_formula(spark, d):
    return lengths(event_frames(spark, d)).select("sample_id", F.col("n").cast("long").alias("n"), frames.window_count(F.col("n"), SIZE, STRIDE).cast("long").alias("windows"))


@query("""SELECT sample_id, count(*) AS n, ((4 - count(*) % 4) % 4)::BIGINT AS pad, round(sum(value) + ((4 - count(*) % 4) % 4) * arg_max(value, t), 4) AS padded_total FROM f GROUP BY 1""")
def tail_padding(spark, d):
    s = frames.sequence_arrays(event_frames(spark, d), "value")
    padded, mask = frames.pad_to_multiple("values", 4)
    s = s.select("sample_id", "n", padded.alias("padded"), mask.alias("mask"))
    pad = F.size(F.filter("mask", lambda m: ~m)).cast("long")
    return s.select("sample_id", F.col("n").cast("long").alias("n"), pad.alias("pad"), F.round(F.aggregate("padded", F.lit(0.0), lambda a, x: a + x), 4).alias("padded_total"))


@query("SELECT sample_id, t // 4 AS k, count(*) AS frames, count(*) = 4 AS complete FROM f GROUP BY 1, 2")
def token_groups(spark, d):
    return frames.token_groups(event_frames(spark, d)).withColumn("k", F.col("k").cast("long"))


@query("SELECT sample_id, (floor((max(s) - min(s)) * (1.0 / 3600) + 1e-9) + 1)::BIGINT AS points FROM f GROUP BY 1")
def target_timeline(spark, d):
    e = event_frames(spark, d).groupBy("sample_id").agg(F.min("s").alias("first_s"), F.max("s").alias("last_s"))
    return e.select("sample_id", timeline.grid_size(F.col("first_s"), F.col("last_s"), HOURLY).alias("points"))


@query("""+ e AS (SELECT sample_id, min(s) AS s0, (floor((max(s) - min(s)) * (1.0 / 3600) + 1e-9))::BIGINT AS last FROM f GROUP BY 1),
    g AS (SELECT sample_id, i, s0 + i / (1.0 / 3600) AS at FROM (SELECT sample_id, s0, unnest(generate_series(0, last)) AS i FROM e)),
    a AS (SELECT sample_id, s, value, lead(s) OVER w AS s1, lead(value) OVER w AS v1 FROM f WINDOW w AS (PARTITION BY sample_id ORDER BY s, t))
    SELECT g.sample_id, g.i, round(CASE WHEN a.s1 IS NULL OR g.at = a.s THEN a.value ELSE a.value + (a.v1 - a.value) * ((g.at - a.s) / (a.s1 - a.s)) END, 5) AS value
    FROM g ASOF JOIN a ON g.sample_id = a.sample_id AND g.at >= a.s""")
def resample_linear(spark, d):
    out = timeline.grid_linear(event_frames(spark, d).select("sample_id", "s", "t", "value"), HOURLY, "sample_id", ties=("t",))
    return out.select("sample_id", "i", F.round("value", 5).alias("value"))


@query("""+ c AS (SELECT sample_id, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS b FROM f GROUP BY 1)
    SELECT sample_id, round(abs(a / 50.0 - b / 30.0), 6) AS duration_error, (floor(least((a - 1) / 50.0, (b - 1) / 30.0) * 20 + 1e-9) + 1)::BIGINT AS points,
        CASE WHEN least(a, b) < 2 THEN 'timeline_shape' WHEN abs(a / 50.0 - b / 30.0) > greatest(0.025, 1.0 / 50 + 1.0 / 30) THEN 'timeline_mismatch'
            WHEN floor(least((a - 1) / 50.0, (b - 1) / 30.0) * 20 + 1e-9) + 1 < 2 THEN 'timeline_too_short' END AS reason FROM c""")
def common_timeline(spark, d):
    c = event_frames(spark, d).groupBy("sample_id").agg(F.count_if(F.col("event_type") == "view").alias("frames_a"), F.count_if(F.col("event_type") == "click").alias("frames_b"))
    out = timeline.common_timeline(c.withColumns({"fps_a": F.lit(50.0), "fps_b": F.lit(30.0)}), FPS)
    return out.select("sample_id", r6("duration_error").alias("duration_error"), "points", "reason")


@query("""+ h AS (SELECT *, ('0x' || substr(sha256(sample_id::VARCHAR), 1, 16))::UBIGINT % 100 AS b FROM f)
    SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(greatest(stddev_pop(value), 1e-4), 6) AS std FROM h WHERE b < 90 GROUP BY 1""")
def normalizer_fit_scalar(spark, d):
    train = splits.stable_split(F.col("sample_id")) == "train"
    from strideflow.operators import normalize

    return normalize.fit_scalar(event_frames(spark, d), "value", ["event_type"], train).select("event_type", "n", r6("mean").alias("mean"), r6("std").alias("std"))


@query("""+ c AS (SELECT sample_id, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS b FROM f GROUP BY 1)
    SELECT sample_id, abs(a / 20.0 - b / 20.0) <= greatest(1 / 20.0, 1 / 20.0) + 1e-6 AS paired FROM c""")
def pair_duration_gate(spark, d):
    c = event_frames(spark, d).groupBy("sample_id").agg(F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_type") == "click").alias("b"))
    return c.select("sample_id", joins.manifest_duration_gate(F.col("a"), F.lit(20.0), F.col("b"), F.lit(20.0)).alias("paired"))


_GATES = """+ g AS (SELECT sample_id, max(abs(vel)) / 2000 AS max_root_speed, max(value) / 15 AS max_angular_speed, max(abs(vel)) / 300 AS max_dof_speed,
        CASE WHEN stddev_pop(value) > 1e-5 AND stddev_pop(abs(vel)) > 1e-5 THEN corr(value, abs(vel)) ELSE 1 END AS energy_correlation,
        greatest(0, -min(value - 0.1)) AS foot_penetration FROM v GROUP BY 1),
    q AS (SELECT *, CASE WHEN max_root_speed > 5 THEN 'g1_root_speed' WHEN max_angular_speed > 20 THEN 'g1_root_angular_speed' WHEN max_dof_speed > 30 THEN 'g1_dof_speed'
        WHEN energy_correlation < -0.1 THEN 'pair_energy_alignment' WHEN foot_penetration > 0.05 THEN 'g1_foot_penetration' END AS reason FROM g)"""


def gated(spark, d) -> DataFrame:
    v = event_frames(spark, d).withColumn("vel", frames.backward_difference("value", FPS)).withColumns({"speed": F.abs("vel"), "height": F.col("value") - 0.1})
    g = v.groupBy("sample_id").agg(
        (F.max("speed") / 2000).alias("max_root_speed"), (F.max("value") / 15).alias("max_angular_speed"), (F.max("speed") / 300).alias("max_dof_speed"),
        quality.guarded_corr("value", "speed").alias("energy_correlation"), quality.penetration("height").alias("foot_penetration"),
    )
    return g.withColumn("reason", quality.first_failure(quality.aligned_gates()))


@query(_GATES + " SELECT sample_id, round(max_root_speed, 6) AS max_root_speed, round(foot_penetration, 6) AS foot_penetration, reason FROM q")
def quality_gate_reason(spark, d):
    return gated(spark, d).select("sample_id", r6("max_root_speed").alias("max_root_speed"), r6("foot_penetration").alias("foot_penetration"), "reason")


@query(_GATES + " SELECT reason, count(*) AS n FROM q WHERE reason IS NOT NULL GROUP BY 1")
def quarantine_counts(spark, d):
    return quality.route(gated(spark, d))[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("""+ u AS (SELECT event_type, 'value' AS metric, value AS x FROM v UNION ALL SELECT event_type, 'vel', vel FROM v)
    SELECT event_type, metric, count(x) AS n, round(min(x), 6) AS minimum, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.95), 6) AS p95, round(max(x), 6) AS maximum FROM u GROUP BY 1, 2""")
def quality_summary(spark, d):
    v = event_frames(spark, d).withColumn("vel", frames.backward_difference("value", FPS))
    return quality.summary(v, ["event_type"], ["value", "vel"]).select("event_type", "metric", "n", *[r6(c).alias(c) for c in ("minimum", "median", "p95", "maximum")])


@query("SELECT sample_id, round(CASE WHEN stddev_pop(value) > 1e-5 AND stddev_pop(abs(vel)) > 1e-5 THEN corr(value, abs(vel)) ELSE 1 END, 6) AS energy_correlation FROM v GROUP BY 1")
def energy_correlation(spark, d):
    v = event_frames(spark, d).withColumn("speed", F.abs(frames.backward_difference("value", FPS)))
    return v.groupBy("sample_id").agg(r6(quality.guarded_corr("value", "speed")).alias("energy_correlation"))


@query("""+ p AS (SELECT sample_id, t, value, abs(vel) AS speed, quantile_cont(value, 0.02) OVER (PARTITION BY sample_id) AS floor_y FROM v)
    SELECT sample_id, t, round(floor_y, 6) AS floor_y, value - floor_y <= 20 AND speed <= 900 AS contact FROM p""")
def foot_contact(spark, d):
    f = event_frames(spark, d)
    out = quality.foot_contact(f, "sample_id", "t", "value", F.abs(frames.backward_difference("value", FPS)), 20.0, 900.0)
    return out.select("sample_id", F.col("t").cast("long").alias("t"), r6("floor_y").alias("floor_y"), "contact")


@query("""+ p AS (SELECT sample_id, t, value, abs(vel) AS speed, quantile_cont(value, 0.02) OVER (PARTITION BY sample_id) AS floor_y FROM v)
    SELECT sample_id, round(coalesce(quantile_cont(speed, 0.95) FILTER (value - floor_y <= 20 AND t > 0), 0), 6) AS slide FROM p GROUP BY 1""")
def near_floor_slide_p95(spark, d):
    f = event_frames(spark, d).withColumns({"speed": F.when(F.col("t") > 0, F.abs(frames.backward_difference("value", FPS))), "floor_y": F.percentile("value", 0.02).over(Window.partitionBy("sample_id"))})
    return f.groupBy("sample_id").agg(r6(quality.near_floor_slide("value", "speed", "floor_y", 20.0)).alias("slide"))


@query("""+ x AS (SELECT sample_id, t, value, vel / 20 AS pred, event_type <> 'error' AS m, lag(event_type <> 'error') OVER w AS pm, value - lag(value) OVER w AS dt, vel / 20 - lag(vel / 20) OVER w AS dp
        FROM v WINDOW w AS (PARTITION BY sample_id ORDER BY t)),
    y AS (SELECT CASE WHEN m THEN CASE WHEN abs(pred - value) < 1 THEN 0.5 * (pred - value) * (pred - value) ELSE abs(pred - value) - 0.5 END END AS r,
        CASE WHEN m AND coalesce(pm, false) THEN CASE WHEN abs(dp - dt) < 1 THEN 0.5 * (dp - dt) * (dp - dt) ELSE abs(dp - dt) - 0.5 END END AS q FROM x)
    SELECT round(avg(r), 5) AS reconstruction, round(avg(q), 5) AS velocity, round(avg(r) + 0.5 * avg(q), 5) AS loss FROM y""")
def smooth_l1_loss(spark, d):
    f = event_frames(spark, d).withColumns({"pred": frames.backward_difference("value", FPS) / 20, "m": F.col("event_type") != "error"})
    out = metrics.masked_velocity_loss(f, frames.by_sample(), "value", "pred", "m")
    return out.select(*[F.round(c, 5).alias(c) for c in ("reconstruction", "velocity", "loss")])


@query("""+ h AS (SELECT floor(value)::BIGINT % 256 AS token_id, count(*) AS n FROM f WHERE event_type <> 'error' GROUP BY 1)
    SELECT r.range AS token_id, coalesce(n, 0) AS n FROM range(256) r LEFT JOIN h ON r.range = h.token_id""")
def codebook_histogram(spark, d):
    t = event_frames(spark, d).withColumn("token_id", F.floor("value") % 256)
    return codebook.histogram(t, mask=F.col("event_type") != "error")


@query("""+ h AS (SELECT floor(value)::BIGINT % 256 AS token_id, count(*) AS n FROM f WHERE event_type <> 'error' GROUP BY 1), s AS (SELECT sum(n) AS total FROM h)
    SELECT max(total)::BIGINT AS total, count(*) AS used, round(1 - count(*) / 256.0, 6) AS dead_ratio, round(exp(-sum(n / total * ln(n / total))), 6) AS perplexity, min(token_id) AS lowest, max(token_id) AS highest FROM h, s""")
def codebook_stats(spark, d):
    t = event_frames(spark, d).withColumn("token_id", F.floor("value") % 256)
    u = codebook.usage(codebook.histogram(t, mask=F.col("event_type") != "error"))
    return u.select(F.col("total").cast("long").alias("total"), "used", r6("dead_ratio").alias("dead_ratio"), r6("perplexity").alias("perplexity"), "lowest", "highest")


@query("+ k AS (SELECT sample_id, ceil(n / 4.0)::BIGINT AS tokens FROM n) SELECT sample_id, tokens, (sum(tokens) OVER w - tokens)::BIGINT AS offset_start, (sum(tokens) OVER w)::BIGINT AS offset_end FROM k WINDOW w AS (ORDER BY sample_id)")
def token_offsets(spark, d):
    k = lengths(event_frames(spark, d)).select("sample_id", F.ceil(F.col("n") / 4).cast("long").alias("tokens"))
    return corpus.token_offsets(k, "sample_id").select("sample_id", "tokens", F.col("offset_start").cast("long").alias("offset_start"), F.col("offset_end").cast("long").alias("offset_end"))


@query("""+ o AS (SELECT sample_id % 4 AS shard, sample_id, n, sum(n) OVER w - n + CASE WHEN sample_id % 50 = 7 THEN 1 ELSE 0 END AS a, sum(n) OVER w AS b FROM n WINDOW w AS (PARTITION BY sample_id % 4 ORDER BY sample_id)),
    q AS (SELECT shard, a <> coalesce(lag(b) OVER (PARTITION BY shard ORDER BY sample_id), 0) AS gap FROM o) SELECT shard, count(*) AS sequences, count_if(gap)::BIGINT AS gaps FROM q GROUP BY 1""")
def offset_contiguity_audit(spark, d):
    o = lengths(event_frames(spark, d)).withColumn("shard", F.col("sample_id") % 4)
    start, end = frames.frame_bounds("n", "sample_id", shard="shard")
    o = o.select("shard", "sample_id", start, end).withColumn("frame_start", F.col("frame_start") + F.when(F.col("sample_id") % 50 == 7, 1).otherwise(0))
    return corpus.contiguity_audit(o, "shard", "sample_id")


@query("""+ o AS (SELECT CASE WHEN b < 90 THEN 'train' WHEN b < 95 THEN 'val' ELSE 'test' END AS split, sample_id, n FROM (SELECT *, ('0x' || substr(sha256(sample_id::VARCHAR), 1, 16))::UBIGINT % 100 AS b FROM n)),
    r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sample_id) AS i FROM o),
    p AS (SELECT split, sample_id, n, i, 0::BIGINT AS shard, 0::BIGINT AS frame_start FROM r WHERE i = 1 UNION ALL
        SELECT r.split, r.sample_id, r.n, r.i, CASE WHEN p.frame_start + p.n + r.n > 500 THEN p.shard + 1 ELSE p.shard END, CASE WHEN p.frame_start + p.n + r.n > 500 THEN 0 ELSE p.frame_start + p.n END
        FROM p JOIN r ON r.split = p.split AND r.i = p.i + 1)
    SELECT split, sample_id, n, shard, frame_start FROM p""")
def shard_packing(spark, d):
    s = lengths(event_frames(spark, d)).withColumn("split", splits.stable_split(F.col("sample_id")))
    return corpus.pack_shards(s, "split", "sample_id", "n", 500)


CATALOGUE["shard_packing"] = (shard_packing, CATALOGUE["shard_packing"][1].replace("WITH", "WITH RECURSIVE", 1))


@query("""SELECT sample_id, t, value, (props->>'k')::BIGINT AS k FROM f""")
def json_props(spark, d):
    p = F.from_json("props", "k bigint", {"mode": "FAILFAST"})
    return event_frames(spark, d).select("sample_id", F.col("t").cast("long").alias("t"), "value", p["k"].alias("k"))


@query("""+ k AS (SELECT unnest(generate_series(-8, 8)) AS j), z AS (SELECT sum(exp(-0.5 * (j / 4.0) ** 2)) AS z FROM k),
    x AS (SELECT f.sample_id, f.t, least(greatest(f.t + j, 0), n.n - 1) AS u, exp(-0.5 * (j / 4.0) ** 2) / z AS w FROM f JOIN n USING (sample_id), k, z)
    SELECT x.sample_id, x.t, round(sum(w * f.value), 5) AS smooth FROM x JOIN f ON f.sample_id = x.sample_id AND f.t = x.u GROUP BY 1, 2""")
def gaussian_smooth(spark, d):
    return event_frames(spark, d).select("sample_id", F.col("t").cast("long").alias("t"), F.round(frames.gaussian_smooth("value", 4.0, 8), 5).alias("smooth"))


@query("""+ l AS (SELECT (sample_id * 100 + t) // 64 AS batch, abs(vel) AS x FROM v) SELECT round(avg(m), 5) AS loss FROM (SELECT batch, avg(x) AS m FROM l GROUP BY 1)""")
def mean_of_batches(spark, d):
    f = event_frames(spark, d).select(F.floor((F.col("sample_id") * 100 + F.col("t")) / 64).alias("batch"), F.abs(frames.backward_difference("value", FPS)).alias("x"))
    return metrics.mean_of_batches(f, "batch", "x").select(F.round("loss", 5).alias("loss"))


@query("""SELECT event_type, count(*) AS n, bool_and(value < 'inf'::DOUBLE AND value > '-inf'::DOUBLE) AS finite, count_if(value <= 0)::BIGINT AS below FROM f GROUP BY 1""")
def contract_predicates(spark, d):
    return event_frames(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.bool_and(quality.finite(F.col("value"))).alias("finite"), F.count_if(F.col("value") <= 0).alias("below"))


@query("""+ x AS (SELECT sample_id, t, vel, lead(value) OVER w - value AS fd, value - lag(value) OVER w AS bd FROM v WINDOW w AS (PARTITION BY sample_id ORDER BY t))
    SELECT sample_id, count_if(coalesce(fd, bd, 0) ** 2 < 100)::BIGINT AS contacts FROM x GROUP BY 1""")
def human_contact_count(spark, d):
    f = event_frames(spark, d).withColumn("disp", frames.forward_difference("value"))
    return f.groupBy("sample_id").agg(F.count_if(quality.human_contact(F.col("disp") * F.col("disp"), 100.0)).alias("contacts"))


@query("""+ x AS (SELECT n.sample_id, n, CASE WHEN n.sample_id % 4 = 3 THEN 'source_dataset' WHEN n.sample_id % 5 = 0 THEN 'source_locator' WHEN n < 10 THEN 'source_frame_range' END AS reason FROM n)
    SELECT x.sample_id, reason, (CASE WHEN reason IS NULL THEN 8 END)::BIGINT AS frames,
        round(CASE WHEN reason IS NULL THEN sum(value) FILTER (t >= 2 AND t < 10) * 3 END, 4) AS total FROM x JOIN f ON f.sample_id = x.sample_id GROUP BY 1, 2""")
def source_pairs(spark, d):
    """Records of two sources over one row container, which lacks every fifth sequence."""
    s = frames.sequence_arrays(event_frames(spark, d), "value")
    each = lambda k: F.flatten(F.transform("values", lambda v: F.array_repeat(v.cast("double"), k)))
    dof = F.flatten(F.transform("values", lambda v: F.array(v.cast("double"), v.cast("double") * 2)))
    arrays = F.create_map(*[c for k, a in (("joints", each(66)), ("root_pos", each(3)), ("root_rot", each(4)), ("dof_pos", dof)) for c in (F.lit(k), a)])
    rows = s.where("sample_id % 5 <> 0").select(F.lit("rows").alias("path"), F.col("sample_id").cast("string").alias("locator"), F.lit(0).cast("long").alias("row"), arrays.alias("arrays"), F.create_map().cast("map<string,array<string>>").alias("names"))
    ref = F.struct(F.lit("rows").alias("path"), F.col("sample_id").cast("string").alias("locator"), F.lit(20.0).alias("fps"), F.lit(2).alias("frame_start"), F.lit(10).alias("frame_end"))
    source = F.when(F.col("sample_id") % 4 == 3, "other").otherwise("Inter-X").alias("source_dataset")
    out = containers.load_pairs(s.select("sample_id", source, ref.alias("human"), ref.alias("g1")), rows, ("first", "second"))
    total = F.aggregate("dof", F.lit(0.0), lambda a, x: a + x)
    return out.select("sample_id", "reason", (F.size("dof") / 2).cast("long").alias("frames"), F.round(total, 4).alias("total"))


@query("""+ g AS (SELECT sample_id, s <= lag(s) OVER (PARTITION BY sample_id ORDER BY t) AS falls FROM f), o AS (SELECT sample_id, bool_or(coalesce(falls, false)) AS falls FROM g GROUP BY 1)
    SELECT n.sample_id, CASE WHEN n % 2 <> 0 THEN 'width' WHEN n % 4 <> 0 THEN 'alignment' END AS sequence, CASE WHEN n < 2 THEN 'length' WHEN falls THEN 'order' END AS timeline,
        CASE WHEN n - 8 <= 0 THEN 'dimension' WHEN n % 4 <> 0 THEN 'alignment' END AS windows FROM n JOIN o ON o.sample_id = n.sample_id""")
def sequence_contracts(spark, d):
    rows = F.sort_array(F.collect_list(F.struct("t", "value", "s")))
    s = event_frames(spark, d).groupBy("sample_id").agg(rows.alias("rows"))
    n, mask = F.size("rows"), F.transform("rows.t", lambda t: t > -1)
    half = F.transform(F.sequence(F.lit(1), F.ceil(F.size(mask) / 2)), lambda k: k > 0)
    return s.select(
        "sample_id", contracts.sequence_reason(F.col("rows.value"), 2, half, 2).alias("sequence"), contracts.timeline_reason(F.col("rows.s"), 2).alias("timeline"), contracts.window_reason(n, n - 8).alias("windows")
    )


@query("""+ q AS (SELECT sample_id, n, ceil(n / 4.0)::BIGINT + CASE WHEN sample_id % 7 = 0 THEN 1 ELSE 0 END AS tokens, ceil(n / 4.0)::BIGINT AS held FROM n),
    o AS (SELECT sample_id, count_if((sample_id * 31 + k) % 260 > 255) AS outside FROM (SELECT DISTINCT sample_id, t // 4 AS k FROM f) GROUP BY 1)
    SELECT q.sample_id AS sequence_id, CASE WHEN tokens <> held THEN 'tokens' WHEN outside > 0 THEN 'token_range' END AS problem FROM q JOIN o ON o.sample_id = q.sample_id WHERE tokens <> held OR outside > 0""")
def cache_contract(spark, d):
    f = event_frames(spark, d)
    tokens = frames.token_groups(f).select(F.col("sample_id").alias("sequence_id"), "k", ((F.col("sample_id") * 31 + F.col("k")) % 260).alias("token_id"))
    count = F.ceil(F.col("n") / 4) + F.when(F.col("sample_id") % 7 == 0, 1).otherwise(0)
    stated = lengths(f).select(F.col("sample_id").alias("sequence_id"), F.col("n").alias("frames"), count.alias("tokens"), (F.ceil(F.col("n") / 4) * 4 - F.col("n")).alias("padding"))
    return contracts.cache_problems(stated, tokens)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Frames, causal speed, contacts, gates, hash split and a summary of each split: the pipeline in one query."""
    f = event_frames(spark, d)
    contacts = quality.foot_contact(f, "sample_id", "t", "value", F.abs(frames.backward_difference("value", FPS)), 20.0, 900.0)
    per = contacts.groupBy("sample_id").agg(F.avg(F.col("contact").cast("double")).alias("contact_share"), F.max("floor_y").alias("floor_y"))
    accepted = gated(spark, d).join(per, "sample_id").withColumn("split", splits.stable_split(F.col("sample_id")))
    return quality.summary(accepted, ["split"], ["contact_share", "floor_y", "max_root_speed"]).withColumn("fps", F.lit(C.TARGET_FPS))
