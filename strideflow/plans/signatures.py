"""Queries over motions, rotations and captions built from the tables, each beside the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.functions import keys
from strideflow.operators import evaluation, splits, timeline
from strideflow.plans.motion import HOURLY, SQL_FRAMES
from strideflow.plans.records import BUCKET, SPLIT
from strideflow.sources.tables import event_frames, table

CATALOGUE: dict[str, tuple] = {}


def query(sql: str):
    def add(f):
        CATALOGUE[f.__name__] = (f, sql.replace("FRAMES", SQL_FRAMES.strip(), 1))
        return f

    return add


@query("""WITH FRAMES, q AS (SELECT sample_id, t, s, [sin(value), cos(value) / 2, 0.3, 0.1 + t % 5] AS q FROM f),
    r AS (SELECT sample_id, t, s, list_transform(q, lambda x: x / sqrt(list_inner_product(q, q))) AS q FROM q),
    e AS (SELECT sample_id, min(s) AS s0, floor((max(s) - min(s)) * (1.0 / 3600) + 1e-9)::BIGINT AS last FROM f GROUP BY 1),
    g AS (SELECT sample_id, i, s0 + i / (1.0 / 3600) AS at FROM (SELECT sample_id, s0, unnest(generate_series(0, last)) AS i FROM e)),
    a AS (SELECT sample_id, s, q, lead(s) OVER w AS s1, lead(q) OVER w AS q1 FROM r WINDOW w AS (PARTITION BY sample_id ORDER BY s, t)),
    b AS (SELECT g.sample_id, g.i, a.q, coalesce(a.q1, a.q) AS q1, CASE WHEN a.s1 IS NULL OR g.at = a.s THEN 0 ELSE (g.at - a.s) / (a.s1 - a.s) END AS u, list_inner_product(a.q, coalesce(a.q1, a.q)) AS d FROM g ASOF JOIN a ON g.sample_id = a.sample_id AND g.at >= a.s),
    c AS (SELECT *, acos(least(abs(d), 1)) AS angle, CASE WHEN d < 0 THEN -1 ELSE 1 END AS sign FROM b),
    m AS (SELECT *, CASE WHEN sin(angle) < 1e-8 THEN 1 - u ELSE sin((1 - u) * angle) / sin(angle) END AS x, CASE WHEN sin(angle) < 1e-8 THEN u ELSE sin(u * angle) / sin(angle) END * sign AS y FROM c),
    n2 AS (SELECT sample_id, i, u, q, list_transform(range(1, 5), lambda k: q[k] * x + q1[k] * y) AS z FROM m),
    o AS (SELECT sample_id, i, CASE WHEN u = 0 THEN q ELSE list_transform(z, lambda v: v / sqrt(list_inner_product(z, z))) END AS z FROM n2)
    SELECT sample_id, i, round(z[1], 5) + 0.0 AS x, round(z[2], 5) + 0.0 AS y, round(z[3], 5) + 0.0 AS z, round(z[4], 5) + 0.0 AS w FROM o""")
def resample_rotation(spark, d):
    """Rotations of events on an hourly grid."""
    f = event_frames(spark, d)
    q = F.array(F.sin("value"), F.cos("value") / 2, F.lit(0.3), F.lit(0.1) + F.col("t") % 5)
    out = timeline.grid_rotations(f.select("sample_id", "s", "t", q.alias("rotation")), HOURLY, "sample_id", ties=("t",))
    return out.select("sample_id", "i", *[(F.round(F.col("rotation")[k], 5) + 0.0).alias(c) for k, c in enumerate("xyzw")])


_WORD = "lambda x: substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2)"
_SIGNATURES = f"""WITH FRAMES, j AS (SELECT sample_id, t, [round(value, 1)::FLOAT, 0.0::FLOAT, (t % 16)::FLOAT] AS root, floor(vel / 8)::FLOAT AS bend FROM v WHERE sample_id % 7 <> 6 OR t < 3),
    moved AS (SELECT sample_id * 2 AS motion_id, sample_id % 3 AS source, t, root, bend FROM j UNION ALL
        SELECT sample_id * 2 + 1, sample_id % 2, t, list_transform(root, lambda x: x + 4::FLOAT), bend FROM j WHERE sample_id % 4 <> 1),
    p AS (SELECT motion_id, source, t, root || [(root[1] + bend / 8::FLOAT)::FLOAT, (root[2] + 1.0::FLOAT)::FLOAT, (root[3] + 0.5::FLOAT)::FLOAT] AS points FROM moved),
    c AS (SELECT motion_id, source, count(*) AS n FROM p GROUP BY ALL),
    pick AS (SELECT motion_id, source, k, round_even(CASE WHEN k = least(n, 64) - 1 THEN (n - 1)::DOUBLE ELSE k * ((n - 1)::DOUBLE / greatest(least(n, 64) - 1, 1)) END, 0)::BIGINT AS t FROM (SELECT *, unnest(generate_series(0, least(n, 64) - 1)) AS k FROM c)),
    words AS (SELECT pick.motion_id, pick.source, pick.k, array_to_string(list_transform(list_transform(range(1, 7), lambda i: printf('%08x', (round_even(((points[i] - points[(i - 1) % 3 + 1])::FLOAT * 1000::FLOAT)::FLOAT::DOUBLE, 0)::BIGINT & 4294967295))), {_WORD}), '') AS h
        FROM pick JOIN p ON p.motion_id = pick.motion_id AND p.t = pick.t),
    s AS (SELECT motion_id, source, {SPLIT(BUCKET.format('motion_id::VARCHAR'))} AS split, signature, CASE {SPLIT(BUCKET.format('motion_id::VARCHAR'))} WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS p
        FROM (SELECT motion_id, source, sha256(unhex(string_agg(h, '' ORDER BY k))) AS signature FROM words GROUP BY 1, 2)),
    g AS (SELECT signature, count(*) AS n, count(DISTINCT split) AS splits, count(DISTINCT source) AS datasets, max(p) AS p, min(motion_id) AS first FROM s GROUP BY 1)"""


def motions(spark, d) -> DataFrame:
    """Motions of two joints from events, and moved copies of most of them, with their signatures."""
    f = event_frames(spark, d)
    from strideflow.operators.frames import backward_difference

    single = lambda x: F.lit(x).cast("float")
    root = F.array(F.round("value", 1).cast("float"), single(0.0), (F.col("t") % 16).cast("float"))
    j = f.select("sample_id", "t", root.alias("root"), F.floor(backward_difference("value", 20.0) / 8).cast("float").alias("bend")).where("sample_id % 7 <> 6 OR t < 3")
    first = j.select((F.col("sample_id") * 2).alias("motion_id"), (F.col("sample_id") % 3).alias("source"), "t", "root", "bend")
    moved = F.transform("root", lambda x: x + single(4.0))
    both = first.union(j.where("sample_id % 4 <> 1").select(F.col("sample_id") * 2 + 1, F.col("sample_id") % 2, "t", moved, "bend"))
    r = [F.col("root")[k] for k in range(3)]
    points = F.array(*r, r[0] + F.col("bend") / single(8.0).cast("double"), r[1] + single(1.0), r[2] + single(0.5)).cast("array<float>")
    whole = both.groupBy("motion_id", "source").agg(F.sort_array(F.collect_list(F.struct("t", points.alias("points"))))["points"].alias("frames"))
    return whole.select("motion_id", "source", splits.motion_signature(F.col("frames"), 2).alias("signature"), splits.stable_split(F.col("motion_id")).alias("split"))


@query(_SIGNATURES + " SELECT motion_id, source, split, signature FROM s")
def motion_signatures(spark, d):
    return motions(spark, d).select("motion_id", "source", "split", "signature")


@query(_SIGNATURES + """ SELECT (SELECT count(*) FROM g) AS groups, (SELECT count(*) FROM g WHERE n > 1) AS shared_groups, (SELECT count(*) FROM g WHERE splits > 1) AS cross_split_groups,
        (SELECT count(*) FROM g WHERE datasets > 1) AS cross_dataset_groups, (SELECT count(*) FROM s JOIN g USING (signature) WHERE s.p <> g.p) AS moved_rows""")
def signature_leakage_audit(spark, d):
    """The leakage audit by motion signature."""
    return splits.leakage_audit(motions(spark, d), "signature", "split", "source")


@query(_SIGNATURES + """, top AS (SELECT * FROM g WHERE n > 1 ORDER BY first, signature LIMIT 20)
    SELECT top.signature, list(s.motion_id ORDER BY s.motion_id)[:10]::VARCHAR AS members, list_sort(list(DISTINCT s.source))::VARCHAR AS datasets, CASE any_value(top.p) WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS final_split
    FROM top JOIN s USING (signature) GROUP BY 1""")
def signature_leakage_examples(spark, d):
    """The first 20 groups of motions with one signature."""
    out = splits.leakage_examples(motions(spark, d), "signature", "split", "source", "motion_id")
    text = lambda c: F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ", "), F.lit("]")).alias(c)
    return out.select("signature", text("members"), text("datasets"), "final_split")


@query("""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (ORDER BY conv_id, turn, role, text) AS r FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
    SELECT conv_id, turn, trim(text) AS text, 'dialogue' AS kind, 'turns' AS source_field, CASE WHEN turn % 3 = 1 THEN turn * 1.0 WHEN turn % 3 = 2 AND turn % 2 = 0 THEN NULL WHEN turn % 3 = 2 THEN turn * 0.5 END AS start_t,
        CASE WHEN turn % 3 = 1 THEN turn + 0.5 END AS end_t, CASE WHEN turn % 3 = 2 AND turn % 2 = 0 THEN 'start_t' END AS problem FROM t WHERE trim(text) <> '' AND role IS NOT NULL""")
def mixed_captions(spark, d):
    """Turns as a JSON list of labels: strings, objects with times, objects with a bad time; and blanks, numbers, lists and nulls, which are no captions."""
    c = table(spark, d, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    turn, text = F.col("turn"), F.col("text")
    quoted = F.to_json(F.struct(F.concat(F.lit(" "), text, F.lit("  ")).alias("proc_label")))
    plain = F.substring(quoted, F.length(F.lit('{"proc_label":')) + 1, F.length(quoted) - F.length(F.lit('{"proc_label":}')))
    start = F.when(turn % 3 == 1, F.to_json(F.struct((turn * 1.0).alias("start_t"), (turn + 0.5).alias("end_t")))).when(turn % 2 == 0, F.lit('{"start_t":"soon"}')).otherwise(F.concat(F.lit('{"start_t":"'), (turn * 0.5).cast("string"), F.lit('"}')))
    timed = F.concat(F.substring(quoted, F.lit(1), F.length(quoted) - 1), F.lit(","), F.substring(start, F.lit(2), F.length(start)))
    label = F.when(F.col("role").isNull(), F.lit("17")).when(turn % 3 == 0, plain).otherwise(timed)
    listed = F.concat(F.lit('[null, 5, ["x"], "  ", {"other": 1}, '), label, F.lit("]"))
    out = c.select("conv_id", "turn", F.explode(keys.captions(listed, "dialogue", "turns")).alias("c"))
    return out.select("conv_id", "turn", "c.text", "c.kind", "c.source_field", "c.start_t", "c.end_t", "c.problem")


_EVALUATED = """WITH e AS (SELECT vec_id, label, list_transform(embedding || embedding[1:11], lambda x: 5 * x::DOUBLE) AS a FROM embeddings WHERE vec_id % 5 <> 0 AND label IS NOT NULL),
    b AS (SELECT vec_id, label, a, list_transform(a, lambda x: x * 0.9 + 0.1) AS b FROM e), d AS (SELECT *, list_transform(range(1, 76), lambda k: abs(b[k] - a[k])) AS d FROM b)"""


def evaluated(spark, d) -> DataFrame:
    """Embeddings as frames of 75 channels by label, and a reconstruction of them that is off by a known rule."""
    e = table(spark, d, "embeddings").where("label IS NOT NULL")
    a = F.transform(F.concat("embedding", F.slice("embedding", 1, 11)), lambda x: x.cast("double") * 5)
    return e.select("vec_id", "label", a.alias("a"), F.transform(a, lambda x: x * 0.9 + 0.1).alias("b"), (F.col("vec_id") % 5 != 0).alias("m"))


@query(_EVALUATED + """, j AS (SELECT label, k, avg(d[k]) AS x FROM d, (SELECT unnest(generate_series(10, 38)) AS k) GROUP BY 1, 2), w AS (SELECT label, max(x) AS x, arg_max(x, (x, -k)) AS y, sum(x) AS total FROM j GROUP BY 1),
    c AS (SELECT label, sum((a[74] >= 0.5 AND b[74] >= 0.5)::INT + (a[75] >= 0.5 AND b[75] >= 0.5)::INT) AS tp, sum((a[74] >= 0.5)::INT + (a[75] >= 0.5)::INT + (b[74] >= 0.5)::INT + (b[75] >= 0.5)::INT) AS pos FROM d GROUP BY 1)
    SELECT d.label, count(*) AS n, round(avg(list_sum(d) / 75), 6) AS mae, round(sqrt(avg(list_inner_product(d, d) / 75)), 6) AS rmse, round(max(list_max(d)), 6) AS max_abs,
        (SELECT min(k) - 10 FROM j WHERE j.label = d.label AND j.x = any_value(w.x)) AS worst_joint, round(any_value(w.x), 6) AS worst_joint_mae, round(degrees(any_value(w.total)), 4) AS degrees_total,
        round(avg(sqrt(d[1] ** 2 + d[2] ** 2 + d[3] ** 2)), 6) AS ade, round(arg_max(sqrt(d[1] ** 2 + d[2] ** 2 + d[3] ** 2), vec_id), 6) AS fde, round(avg(d[2]), 6) AS height,
        round(avg((d[39] + d[40] + d[41]) / 3), 6) AS local_velocity, round(avg((d[42] + d[43] + d[44]) / 3), 6) AS angular_velocity, round(avg(list_sum(d[45:73]) / 29), 6) AS joint_velocity,
        round(coalesce(2 * any_value(c.tp) / nullif(any_value(c.pos), 0), 0), 6) AS contact_f1
    FROM d JOIN w USING (label) JOIN c USING (label) GROUP BY d.label""")
def robot_evaluation(spark, d):
    """The evaluation record of a robot reconstruction for each label."""
    out = evaluation.robot_reconstruction(evaluated(spark, d), ["label"], "vec_id", "a", "b", "m")
    total = F.aggregate("joint_degrees", F.lit(0.0), lambda s, x: s + x)
    rounded = ["mae", "rmse", "max_abs", "worst_joint_mae", "ade", "fde", "height", "local_velocity", "angular_velocity", "joint_velocity", "contact_f1"]
    return out.select("label", "n", F.col("worst_joint").cast("long").alias("worst_joint"), F.round(total, 4).alias("degrees_total"), *[F.round(c, 6).alias(c) for c in rounded])


@query(_EVALUATED + """, p AS (SELECT *, list_transform(range(0, 4), lambda k: sqrt(d[3 * k + 1] ** 2 + d[3 * k + 2] ** 2 + d[3 * k + 3] ** 2)) AS far FROM d),
    c AS (SELECT label, k, a[k] >= 0.5 AS x, b[k] >= 0.5 AS y FROM d, (SELECT unnest([72, 73, 74, 75]) AS k)), s AS (SELECT label, count_if(x AND y) AS tp, count_if(x) AS t, count_if(y) AS p FROM c GROUP BY 1)
    SELECT p.label, count(*) AS n, round(avg(list_sum(p.d) / 75), 6) AS mae, round(sqrt(avg(list_inner_product(p.d, p.d) / 75)), 6) AS rmse, round(max(list_max(p.d)), 6) AS max_abs, round(avg(list_sum(far) / 4), 6) AS mpjpe,
        round(coalesce(any_value(s.tp) / nullif(any_value(s.p), 0), 0), 6) AS contact_precision, round(coalesce(any_value(s.tp) / nullif(any_value(s.t), 0), 0), 6) AS contact_recall
    FROM p JOIN s USING (label) GROUP BY p.label""")
def human_evaluation(spark, d):
    """The evaluation record of a human reconstruction of four joints for each label."""
    out = evaluation.human_reconstruction(evaluated(spark, d), ["label"], "a", "b", "m", (0, 12), (12, 36), (71, 75))
    return out.select("label", "n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "max_abs", "mpjpe", "contact_precision", "contact_recall")])
