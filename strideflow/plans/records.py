"""Queries over record tables (documents, labels, embeddings, orders, pages, conversations), each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideflow.functions import geometry as G
from strideflow.functions import keys
from strideflow.operators import codebook, corpus, joins, metrics, normalize, quality, splits, timeline
from strideflow.sources.tables import table

CATALOGUE: dict[str, tuple] = {}
BUCKET = "(('0x' || substr(sha256({0}), 1, 16))::UBIGINT % 100)"
SPLIT = "CASE WHEN {0} < 90 THEN 'train' WHEN {0} < 95 THEN 'val' ELSE 'test' END".format


def query(sql: str):
    def add(f):
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return add


def r6(c):
    return F.round(c, 6)


def doc_splits(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text", "n_chars")
    return docs.withColumn("split", splits.stable_split(F.col("doc_id")))


_DOCS = f"d AS (SELECT *, {SPLIT(BUCKET.format('doc_id::VARCHAR'))} AS split FROM documents)"


@query(f"SELECT source, {SPLIT(BUCKET.format('source'))} AS split, {BUCKET.format('source')}::INTEGER AS bucket FROM (SELECT DISTINCT source FROM documents)")
def stable_split(spark, d):
    s = table(spark, d, "documents").select("source").distinct()
    return s.select("source", splits.stable_split(F.col("source")).alias("split"), splits.hash_bucket(F.col("source")).alias("bucket"))


@query(f"WITH {_DOCS} SELECT source, CASE max(CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM d GROUP BY 1")
def group_split_priority(spark, d):
    return splits.group_split(doc_splits(spark, d), "source")


_SIGNED = f"WITH {_DOCS}, s AS (SELECT doc_id, source, split, sha256(coalesce(text, '')) AS signature, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS p FROM d)"


@query(_SIGNED + """, g AS (SELECT signature, count(*) AS n, count(DISTINCT split) AS splits, count(DISTINCT source) AS datasets, max(p) AS p FROM s GROUP BY 1)
    SELECT (SELECT count(*) FROM g) AS groups, (SELECT count(*) FROM g WHERE n > 1) AS shared_groups, (SELECT count(*) FROM g WHERE splits > 1) AS cross_split_groups,
        (SELECT count(*) FROM g WHERE datasets > 1) AS cross_dataset_groups, (SELECT count(*) FROM s JOIN g USING (signature) WHERE s.p <> g.p) AS moved_rows""")
def split_leakage_audit(spark, d):
    return splits.leakage_audit(signed(spark, d), "signature", "split", "source")


def signed(spark, d):
    return doc_splits(spark, d).withColumn("signature", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


@query(_SIGNED + """, g AS (SELECT signature, count(*) AS n, max(p) AS p FROM s GROUP BY 1)
    SELECT doc_id, n AS group_size, s.split AS split_before, CASE g.p WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM s JOIN g USING (signature)""")
def leakage_resolution(spark, d):
    return splits.resolve_leakage(signed(spark, d), "signature").select("doc_id", "group_size", "split_before", "split")


@query(_SIGNED + " SELECT signature, count(*) AS n, min(doc_id) AS first_id FROM s GROUP BY 1 HAVING count(*) > 1")
def duplicate_signatures(spark, d):
    return signed(spark, d).groupBy("signature").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def pair_inner(spark, d):
    return joins.matched(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pair_left_anti(spark, d):
    return joins.unmatched(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id"), ["doc_id"])[0]


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def pair_right_anti(spark, d):
    orders = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return joins.unmatched(orders, table(spark, d, "customer").select("c_custkey"), ["c_custkey"])[1]


@query("""SELECT count_if(a IS NOT NULL AND b IS NOT NULL)::BIGINT AS matched, count_if(b IS NULL)::BIGINT AS left_only, count_if(a IS NULL)::BIGINT AS right_only
    FROM (SELECT DISTINCT o_custkey AS a FROM orders) FULL JOIN (SELECT DISTINCT c_custkey AS b FROM customer) ON a = b""")
def pair_inventory(spark, d):
    return joins.inventory(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k")), ["k"])


@query("""WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber > 4 GROUP BY 1)
    SELECT o_orderkey, coalesce(n, 0) AS candidates, CASE WHEN n IS NULL THEN 'no_candidate' WHEN n > 1 THEN 'ambiguous_candidate' END AS reason FROM orders LEFT JOIN c ON o_orderkey = l_orderkey""")
def unique_candidate_join(spark, d):
    lines = table(spark, d, "lineitem").where("l_linenumber > 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.unique_candidate(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", "no_candidate", "ambiguous_candidate")


@query("""WITH c AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), e AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT o_orderkey, len(coalesce(c.a, [])) + len(coalesce(e.a, [])) AS n, array_to_string(list_concat(coalesce(c.a, []), coalesce(e.a, [])), ',') AS parts FROM orders LEFT JOIN c ON o_orderkey = c.l_orderkey LEFT JOIN e ON o_orderkey = e.l_orderkey""")
def lookup_concat(spark, d):
    def parts(flag):
        ordered = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
        return table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(ordered, lambda r: r["l_partkey"]).alias("a"))

    out = joins.lookup_arrays(table(spark, d, "orders").select("o_orderkey"), [(parts("A"), "a"), (parts("R"), "a")], "o_orderkey", "p", "bigint")
    return out.select("o_orderkey", F.size("p").cast("long").alias("n"), F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("parts"))


@query("SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders")
def union_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).unionByName(table(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@query("SELECT DISTINCT doc_id AS k FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def key_except(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("k")).subtract(table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("k")))


@query("SELECT doc_id AS k FROM documents INTERSECT SELECT doc_id FROM labels")
def key_intersect(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("k")).intersect(table(spark, d, "labels").select(F.col("doc_id").alias("k")))


@query(f"WITH {_DOCS} SELECT split, count(*) AS sequences, round(sum(n_chars) / 20.0 / 3600, 6) AS hours, round(count_if(length(text) > 500) / count(*), 6) AS text_coverage FROM d GROUP BY 1")
def corpus_summary(spark, d):
    s = doc_splits(spark, d).withColumn("has_text", F.length("text") > 500)
    return corpus.corpus_summary(s, ["split"], "n_chars", "has_text", 20.0).select("split", "sequences", r6("hours").alias("hours"), r6("text_coverage").alias("text_coverage"))


@query(f"""WITH {_DOCS} SELECT (SELECT count(DISTINCT doc_id) FROM d) AS distinct_ids, (SELECT count(*) FROM d) AS sequences, (SELECT count(*) FROM (SELECT doc_id FROM d GROUP BY 1 HAVING count(*) > 1)) AS duplicate_ids,
    (SELECT count(*) FROM (SELECT source FROM d GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS groups_in_several_splits""")
def corpus_audit(spark, d):
    out = corpus.corpus_audit(doc_splits(spark, d), "doc_id", "source", "split")
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


@query("SELECT l_returnflag, 'l_extendedprice' AS metric, count(*) AS n, round(min(l_extendedprice), 4) AS minimum, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(max(l_extendedprice), 4) AS maximum FROM lineitem GROUP BY 1")
def price_summary(spark, d):
    return quality.summary(table(spark, d, "lineitem"), ["l_returnflag"], ["l_extendedprice"]).select("l_returnflag", "metric", "n", *[F.round(c, 4).alias(c) for c in ("minimum", "median", "p95", "maximum")])


_TRAIN = f"e AS (SELECT * FROM embeddings WHERE {BUCKET.format('vec_id::VARCHAR')} < 90), x AS (SELECT generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM e)"
_STATS = _TRAIN + ", s AS (SELECT dim, count(*) AS n, CASE WHEN dim >= 62 THEN 0 ELSE avg(x) END AS mean, CASE WHEN dim >= 62 THEN 1 ELSE greatest(stddev_pop(x), 1e-4) END AS std FROM x GROUP BY 1)"


@query(f"WITH {_STATS} SELECT dim, n, round(mean, 6) AS mean, round(std, 6) AS std FROM s")
def normalizer_fit_vector(spark, d):
    out = normalize.fit_vector(table(spark, d, "embeddings"), "embedding", splits.stable_split(F.col("vec_id")) == "train", 62)
    return out.select(F.col("dim").cast("long").alias("dim"), "n", r6("mean").alias("mean"), r6("std").alias("std"))


@query(f"""WITH {_STATS}, y AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)
    SELECT vec_id, round(sum((v - mean) / std), 5) AS total, round(max((v - mean) / std), 5) AS highest FROM y JOIN s USING (dim) GROUP BY 1""")
def normalizer_apply(spark, d):
    e = table(spark, d, "embeddings")
    stats = normalize.as_arrays(normalize.fit_vector(e, "embedding", splits.stable_split(F.col("vec_id")) == "train", 62))
    out = normalize.apply(e, "embedding", stats)
    return out.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(F.array_max("embedding"), 5).alias("highest"))


@query("SELECT vec_id, round(greatest(max(greatest(-0.2 - x, x - 0.2)), 0), 6) AS violation FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def dof_limit_violation(spark, d):
    values = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", r6(quality.limit_violation(values, [(-0.2, 0.2)] * 64)).alias("violation"))


@query("""SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT count_if(quality = 1 AND toxic = 1)::BIGINT AS tp, count_if(quality <> 1 AND toxic = 1)::BIGINT AS fp, count_if(quality = 1 AND toxic <> 1)::BIGINT AS fn FROM labels)""")
def contact_metrics(spark, d):
    out = metrics.contact_metrics(table(spark, d, "labels"), F.col("quality"), F.col("toxic"))
    return out.select("tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


def self_pairs(spark, d):
    """Each vector with the next one of its label by id, as target and prediction."""
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, d, "embeddings").withColumn("other", F.lead("embedding").over(w)).where(F.col("other").isNotNull())


_PAIRS = "p AS (SELECT * FROM (SELECT vec_id, label, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) WHERE b IS NOT NULL), x AS (SELECT vec_id, label, generate_subscripts(a, 1) - 1 AS k, unnest(a)::DOUBLE AS a, unnest(b)::DOUBLE AS b FROM p)"


@query(f"WITH {_PAIRS} SELECT label, count(*) AS n, round(avg(abs(a - b)), 6) AS mae, round(sqrt(avg((a - b) ** 2)), 6) AS rmse, round(max(abs(a - b)), 6) AS max_abs FROM x WHERE vec_id % 5 <> 0 GROUP BY 1")
def masked_feature_error(spark, d):
    out = metrics.feature_errors(self_pairs(spark, d), "embedding", "other", ["label"], F.col("vec_id") % 5 != 0)
    return out.select("label", "n", r6("mae").alias("mae"), r6("rmse").alias("rmse"), r6("max_abs").alias("max_abs"))


@query(f"""WITH {_PAIRS}, r AS (SELECT x.*, (a - first_value(a) OVER w) - (b - first_value(b) OVER w) AS q FROM x WHERE k < 63 WINDOW w AS (PARTITION BY vec_id, k % 3 ORDER BY k)),
    j AS (SELECT label, vec_id, k // 3 AS j, sqrt(sum((a - b) ** 2)) AS e, sqrt(sum(q * q)) AS q FROM r GROUP BY 1, 2, 3)
    SELECT label, round(avg(e), 6) AS mpjpe, round(avg(q), 6) AS root_relative_mpjpe FROM j GROUP BY 1""")
def mpjpe(spark, d):
    out = metrics.mean_joint_error(self_pairs(spark, d), "embedding", "other", 21, ["label"])
    return out.select("label", r6("mpjpe").alias("mpjpe"), r6("root_relative_mpjpe").alias("root_relative_mpjpe"))


@query(f"WITH {_PAIRS}, m AS (SELECT label, k, round(avg(abs(a - b)), 9) AS e FROM x GROUP BY 1, 2) SELECT label, k AS joint, round(e, 6) AS mae FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY e DESC, k) AS r FROM m) WHERE r = 1")
def worst_joint(spark, d):
    out = metrics.worst_channel(self_pairs(spark, d), "embedding", "other", ["label"])
    return out.select("label", F.col("joint").cast("long").alias("joint"), r6("mae").alias("mae"))


_RANGES = [(0, 3, 2.0), (3, 9, 2.0), (9, 38, 1.0), (38, 44, 1.0), (44, 62, 0.5), (62, 64, 1.0)]
_HUBER = "CASE WHEN abs({0}) < 1 THEN 0.5 * ({0}) ** 2 ELSE abs({0}) - 0.5 END".format


@query(f"""WITH {_PAIRS}, c(lo, hi, w) AS (VALUES {", ".join(map(str, _RANGES))}),
    v AS (SELECT vec_id, label, k, a * 20 AS a, b * 20 AS b, vec_id % 5 <> 0 AS m FROM x),
    d AS (SELECT *, lag(m) OVER w AS pm, (b - lag(b) OVER w) - (a - lag(a) OVER w) AS q FROM v WINDOW w AS (PARTITION BY label, k ORDER BY vec_id)),
    r AS (SELECT sum(e * w) / sum(w) AS reconstruction FROM (SELECT w, avg({_HUBER("b - a")}) AS e FROM d JOIN c ON k >= lo AND k < hi WHERE m GROUP BY lo, w)),
    t AS (SELECT avg(e) AS temporal FROM (SELECT k < 3 AS root, avg({_HUBER("q")}) AS e FROM d WHERE m AND pm AND (k < 3 OR k BETWEEN 9 AND 37) GROUP BY 1))
    SELECT round(reconstruction, 5) AS reconstruction, round(temporal, 5) AS temporal, round(reconstruction + 0.5 * temporal, 5) AS loss FROM r, t""")
def robot_component_loss(spark, d):
    from pyspark.sql import Window

    scaled = lambda c: F.transform(c, lambda x: x.cast("double") * 20)
    f = self_pairs(spark, d).select("vec_id", "label", scaled("embedding").alias("a"), scaled("other").alias("b"), (F.col("vec_id") % 5 != 0).alias("m"))
    out = metrics.component_loss(f, Window.partitionBy("label").orderBy("vec_id"), "a", "b", "m", _RANGES, [(0, 3), (9, 38)])
    return out.select(*[F.round(c, 5).alias(c) for c in ("reconstruction", "temporal", "loss")])


_CENTRES = "x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, k, avg(x) AS m, count(*) AS n, sum(x) AS s FROM x GROUP BY 1, 2)"
_ASSIGNED = _CENTRES + ", q AS (SELECT x.vec_id, x.label, c.label AS code, round(sum((x - m) ** 2), 9) AS d FROM x JOIN c USING (k) GROUP BY 1, 2, 3), a AS (SELECT vec_id, label, code, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, code) AS r FROM q) WHERE r = 1)"


@query(f"WITH {_ASSIGNED} SELECT vec_id, code::BIGINT AS token_id, round(d, 6) AS distance FROM a")
def vq_assign(spark, d):
    e = table(spark, d, "embeddings")
    return codebook.assign(e, "embedding", codebook.centres(e, "embedding", "label").withColumnRenamed("label", "code")).select("vec_id", "token_id", r6("distance").alias("distance"))


@query(f"""WITH {_ASSIGNED}, t AS (SELECT code, k, count(*) AS n, sum(x) AS s FROM a JOIN x USING (vec_id) GROUP BY 1, 2)
    , o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS vectors FROM embeddings), f AS (SELECT r, vectors, k, x FROM o JOIN x USING (vec_id)),
    m AS (SELECT c.label, c.k, 0.99::DOUBLE * c.n / (1 + c.label ** 3) + 0.01::DOUBLE * coalesce(t.n, 0) AS mass, 0.99::DOUBLE * c.s / (1 + c.label ** 3) + 0.01::DOUBLE * coalesce(t.s, 0) AS s FROM c LEFT JOIN t ON t.code = c.label AND t.k = c.k),
    d AS (SELECT label, mass < 1 AS dead, CASE WHEN mass < 1 THEN 1 ELSE mass END AS mass, CASE WHEN mass < 1 THEN x ELSE s END AS s FROM m JOIN f ON f.k = m.k AND f.r = m.label % f.vectors)
    SELECT label::BIGINT AS code, any_value(dead) AS dead, round(any_value(mass)::DOUBLE, 5) AS mass, round(sum(s), 5) AS sums, round(sum(s / mass), 5) AS centre FROM d GROUP BY 1""")
def ema_codebook_step(spark, d):
    e = table(spark, d, "embeddings")
    c = codebook.centres(e, "embedding", "label").withColumnRenamed("label", "code").withColumn("code", F.col("code").cast("long"))
    a = codebook.assign(e, "embedding", c)
    worn = 1 + F.pow("code", F.lit(3.0))  # some codes are about to die
    book = c.select("code", (F.col("n") / worn).alias("mass"), F.transform("centre", lambda x: x * F.col("n") / worn).alias("sums"))
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), 5)
    return codebook.ema_update(book, a, "embedding", "vec_id", 0.99).select("code", "dead", F.round("mass", 5).alias("mass"), total("sums").alias("sums"), total("centre").alias("centre"))


_TURNS = "t AS (SELECT conv_id, turn, length(text) % 256 AS h, (length(text) * 7) % 256 AS g FROM conversations)"


@query(f"WITH {_TURNS} SELECT conv_id, turn, array_to_string(list(h) OVER w, ',') AS human_prefix, array_to_string(coalesce(list(g) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []), ',') AS robot_prefix, g AS target FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def teacher_prefix(spark, d):
    return joined(corpus.teacher_examples(turns(spark, d), "conv_id", "turn", "h", "g"))


@query(f"WITH {_TURNS} SELECT * FROM (SELECT conv_id, turn, array_to_string(list(h) OVER w, ',') AS human_prefix, array_to_string(list(g) OVER w, ',') AS robot_prefix, lead(g) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE target IS NOT NULL")
def student_prefix(spark, d):
    return joined(corpus.student_examples(turns(spark, d), "conv_id", "turn", "h", "g"))


def turns(spark, d):
    n = F.length("text").cast("long")
    return table(spark, d, "conversations").select("conv_id", "turn", (n % 256).alias("h"), ((n * 7) % 256).alias("g"))


def joined(df):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return df.withColumns({"human_prefix": text("human_prefix"), "robot_prefix": text("robot_prefix")})


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR || ':7'), doc_id) AS r FROM documents) WHERE r <= 5")
def stratified_sample(spark, d):
    return splits.stratified_sample(table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 5, 7).select("lang", "doc_id")


@query("""WITH x AS (SELECT lang, doc_id, 'n_chars' AS metric, n_chars::DOUBLE AS v FROM documents UNION ALL SELECT lang, doc_id, 'n_words', length(text) - length(replace(text, ' ', '')) FROM documents)
    SELECT lang, metric, first(doc_id ORDER BY v, doc_id) AS low_key, first(doc_id ORDER BY v DESC, doc_id) AS high_key FROM x GROUP BY 1, 2""")
def extreme_rows(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("n_words"))
    return splits.extremes(docs, "lang", "doc_id", ["n_chars", "n_words"])


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(doc_id::VARCHAR || ':11-3'), doc_id) - 1 AS place, count(*) OVER () AS n FROM documents) SELECT doc_id, place FROM o WHERE place < n - n % 4 AND place % 4 = 1")
def epoch_rank_stride(spark, d):
    return splits.epoch_slice(table(spark, d, "documents").select("doc_id"), "doc_id", 11, 3, 1, 4).select("doc_id", "place")


@query("""WITH u AS (SELECT page_id, 'url' AS source_field, url AS text FROM pages UNION ALL SELECT page_id, 'html', html FROM pages UNION ALL SELECT page_id, 'blank', '  ' FROM pages)
    SELECT page_id, source_field, trim(text) AS text FROM u WHERE length(trim(text)) > 0""")
def caption_unpivot(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", "html", F.lit("  ").alias("blank"))
    return keys.unpivot_captions(p, "page_id", ["url", "html", "blank"])


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', './pose_data/'), '[?#].*$', '') || '_poses.npy' AS path FROM pages),
    q AS (SELECT page_id, regexp_replace(regexp_replace(path, '^\./', ''), '^pose_data/', '') AS p FROM p)
    SELECT page_id, regexp_replace(lower(regexp_replace(p, '/?[^/]*$', '')), '[^a-z0-9/]', '', 'g') AS folder, regexp_replace(lower(regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\.npy$', '')), '[^a-z0-9]', '', 'g') AS name FROM q""")
def key_canonicalise(spark, d):
    path = F.concat(F.regexp_replace(F.regexp_replace("url", "^https?://", "./pose_data/"), "[?#].*$", ""), F.lit("_poses.npy"))
    folder, name = keys.canonical_motion_key(path)
    return table(spark, d, "pages").select("page_id", folder.alias("folder"), name.alias("name"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 97 AS s, o_orderkey % 97 + 1 + o_custkey % 120 AS e, 219 AS h, 300 + o_custkey % 100 AS g FROM orders)
    SELECT o_orderkey, s * g // h AS first_frame, least((e * g + h - 1) // h, g) AS last_frame, round(20.0 * g / h, 6) AS fps FROM o""")
def clip_bounds(spark, d):
    s = F.col("o_orderkey") % 97
    a, b, fps = timeline.clip_bounds(s, s + 1 + F.col("o_custkey") % 120, F.lit(219), 300 + F.col("o_custkey") % 100)
    return table(spark, d, "orders").select("o_orderkey", a.alias("first_frame"), b.alias("last_frame"), r6(fps).alias("fps"))


@query("SELECT min(doc_id) AS lowest, max(doc_id) AS highest, count(*) AS n, round(20.0 / 4, 6) AS token_rate FROM documents")
def manifest_extent(spark, d):
    return table(spark, d, "documents").agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest"), F.count("*").alias("n"), F.lit(joins.token_rate()).alias("token_rate"))


#: A unit quaternion and a second one from the first eight channels, as SQL columns.
_Q = """q AS (SELECT vec_id, e[1] / n AS x, e[2] / n AS y, e[3] / n AS z, e[4] / n AS w, e[5] / m AS x1, e[6] / m AS y1, e[7] / m AS z1, e[8] / m AS w1 FROM
    (SELECT vec_id, e, sqrt(e[1] ** 2 + e[2] ** 2 + e[3] ** 2 + e[4] ** 2) AS n, sqrt(e[5] ** 2 + e[6] ** 2 + e[7] ** 2 + e[8] ** 2) AS m FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)))"""
_M = """m AS (SELECT *, 1 - 2 * (y * y + z * z) AS m0, 2 * (x * y - z * w) AS m1, 2 * (x * z + y * w) AS m2, 2 * (x * y + z * w) AS m3, 1 - 2 * (x * x + z * z) AS m4, 2 * (y * z - x * w) AS m5,
    2 * (x * z - y * w) AS m6, 2 * (y * z + x * w) AS m7, 1 - 2 * (x * x + y * y) AS m8 FROM q)"""


def rotations(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", G.normalize(F.slice("embedding", 1, 4)).alias("q"), G.normalize(F.slice("embedding", 5, 4)).alias("q1"), F.slice("embedding", 9, 3).alias("p"), F.slice("embedding", 12, 3).alias("o"), "embedding")


def listed(a, names: list[str]) -> list:
    return [r6(F.get(a, F.lit(k))).alias(n) for k, n in enumerate(names)]


@query(f"WITH {_Q} SELECT vec_id, round(CASE WHEN w < 0 THEN -x ELSE x END, 6) AS x, round(CASE WHEN w < 0 THEN -z ELSE z END, 6) AS y, round(CASE WHEN w < 0 THEN y ELSE -y END, 6) AS z, round(abs(w), 6) AS w FROM q")
def quaternion_basis(spark, d):
    return rotations(spark, d).select("vec_id", *listed(G.quaternion_to_y_up(F.col("q")), list("xyzw")))


@query(f"WITH {_Q}, {_M} SELECT vec_id, " + ", ".join(f"round(m{k}, 6) AS m{k}" for k in range(9)) + " FROM m")
def quat_to_matrix(spark, d):
    return rotations(spark, d).select("vec_id", *listed(G.to_matrix(F.col("q")), [f"m{k}" for k in range(9)]))


@query(f"WITH {_Q} SELECT vec_id, round(CASE WHEN w < 0 THEN -x ELSE x END, 6) AS x, round(CASE WHEN w < 0 THEN -y ELSE y END, 6) AS y, round(CASE WHEN w < 0 THEN -z ELSE z END, 6) AS z, round(abs(w), 6) AS w FROM q")
def matrix_to_quat(spark, d):
    return rotations(spark, d).select("vec_id", *listed(G.from_matrix(G.to_matrix(F.col("q"))), list("xyzw")))


@query(f"WITH {_Q}, {_M} SELECT vec_id, round(m0, 6) AS a0, round(m3, 6) AS a1, round(m6, 6) AS a2, round(m1, 6) AS b0, round(m4, 6) AS b1, round(m7, 6) AS b2, round(m2, 6) AS c0 FROM m")
def rot6d(spark, d):
    six = G.matrix_to_6d(G.to_matrix(F.col("q")))
    r = rotations(spark, d).select("vec_id", six.alias("six")).withColumn("back", G.matrix_from_6d(F.col("six")))
    return r.select("vec_id", *listed(F.col("six"), ["a0", "a1", "a2", "b0", "b1", "b2"]), r6(F.get("back", F.lit(2))).alias("c0"))


@query(f"""WITH {_Q}, a AS (SELECT *, x * x1 + y * y1 + z * z1 + w * w1 AS d FROM q), b AS (SELECT *, acos(least(abs(d), 1)) AS t, CASE WHEN d < 0 THEN -1 ELSE 1 END AS g FROM a),
    c AS (SELECT *, sin(0.7 * t) / sin(t) AS u, sin(0.3 * t) / sin(t) * g AS v FROM b), e AS (SELECT vec_id, x * u + x1 * v AS x, y * u + y1 * v AS y, z * u + z1 * v AS z, w * u + w1 * v AS w FROM c), f AS (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS n FROM e)
    SELECT vec_id, round(x / n, 6) AS x, round(y / n, 6) AS y, round(z / n, 6) AS z, round(w / n, 6) AS w FROM f""")
def slerp(spark, d):
    return rotations(spark, d).select("vec_id", *listed(G.slerp(F.col("q"), F.col("q1"), F.lit(0.3)), list("xyzw")))


@query(f"""WITH {_Q}, {_M}, b AS (SELECT m.vec_id, m0 / sqrt(m0 ** 2 + m6 ** 2) AS fx, m6 / sqrt(m0 ** 2 + m6 ** 2) AS fz, e[9] - e[12] AS dx, e[10] AS dy, e[11] - e[14] AS dz
        FROM m JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) USING (vec_id))
    SELECT vec_id, round(fz * dx - fx * dz, 6) AS side, round(dy, 6) AS up, round(fx * dx + fz * dz, 6) AS forward FROM b""")
def episode_frame(spark, d):
    r = rotations(spark, d)
    return r.select("vec_id", *listed(G.to_episode(F.col("p"), F.col("o"), G.episode_basis(F.col("q"))), ["side", "up", "forward"]))


@query(f"""WITH {_Q}, r AS (SELECT *, sqrt(x * x + y * y + z * z) AS s, CASE WHEN w < 0 THEN -1 ELSE 1 END AS g FROM q)
    SELECT vec_id, round(x * g * 2 * atan2(s, w * g) / s, 5) AS rx, round(y * g * 2 * atan2(s, w * g) / s, 5) AS ry, round(z * g * 2 * atan2(s, w * g) / s, 5) AS rz FROM r""")
def rotvec(spark, d):
    # a column for each step: nested calls would repeat each other's expressions
    r = rotations(spark, d).withColumn("m", G.to_matrix(F.col("q"))).withColumn("r", G.from_matrix(F.col("m"))).withColumn("v", G.rotvec(F.col("r")))
    r = r.withColumn("m", G.rotvec_to_matrix(F.col("v"))).withColumn("r", G.from_matrix(F.col("m"))).withColumn("v", G.rotvec(F.col("r")))
    return r.select("vec_id", *[F.round(F.get("v", F.lit(k)), 5).alias(n) for k, n in enumerate(["rx", "ry", "rz"])])


@query(f"WITH {_Q} SELECT vec_id, round(2 * acos(least(abs(x * x1 + y * y1 + z * z1 + w * w1), 1)), 5) AS angle FROM q")
def rotation_geodesic(spark, d):
    return rotations(spark, d).select("vec_id", F.round(G.geodesic(G.to_matrix(F.col("q")), G.to_matrix(F.col("q1"))), 5).alias("angle"))


@query("SELECT label, round(sum(atan2(sin(a - b), cos(a - b))), 5) AS total FROM (SELECT label, embedding[1]::DOUBLE * 40 AS a, embedding[2]::DOUBLE * 40 AS b FROM embeddings) GROUP BY 1")
def yaw_difference(spark, d):
    a, b = (F.get("embedding", F.lit(k)).cast("double") * 40 for k in (0, 1))
    return table(spark, d, "embeddings").select("label", metrics.wrapped_difference(a, b).alias("y")).groupBy("label").agg(F.round(F.sum("y"), 5).alias("total"))
