"""Hard negatives by K-means inverted lists with stored radii.

Rows are dealt to the nearest of K centroids, which are fitted by Lloyd's rounds on a bounded sample (`SAMPLE` rows, the least by hash of vec_id); every row
is in the list of one centroid, and the list's radius, the greatest distance of its rows from the centroid, is stored. For an anchor a and a list with
centroid c and radius r, all inner products lie in <a, c> +- |a| r by Cauchy and Schwarz. A request of an anchor asks for the first `TOP` rows whose
score lies in a window, of the anchor's label or of other labels; it visits the lists whose bounds meet the window, in the order of their upper bound, and is done
when the next bound is strictly below its kth score; a bound that equals it is visited, since ties go to the smaller vec_id. So the results
are those of a full search.

Visits run in two steps for all anchors at once: the first lists of each request, which give a kth score, then all lists that this score
does not rule out. A visit is a row sent to the list. Lists are cut by hash of vec_id into blocks of about `BLOCK` rows, so a list that
holds most rows is many blocks, and the visitors of a block are dealt to tasks by `VISITORS`. A task meets a block first and then its visitors, and multiplies them as matrices.
Centroids and radii, at most `LISTS` of them, are all that is broadcast.

Components become floor(256 x), and those beyond +- 2^26 count as that, so that scores are whole numbers of 64 bits. Rows with a null vec_id, label, vector or component, or a component
that is not finite, take no part. A shorter vector counts as followed by zeros, an empty one as all zeros. Rows with equal vec_id are one, that with the least label and then
vector. An anchor without other rows of its label gives no rows, and neither does a positive without a negative in its window. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideflow.llm.storage import materialise, tidy

SCALE = 256
LIMIT = 1 << 26
ANCHORS = 100
TOP = 5
LOW = 80
SAMPLE = 16384
ROUNDS = 8
LISTS = 1024
BLOCK = 1024
VISITORS = 65536
FIRST = 4096
LEAST, MOST = -(1 << 62), 1 << 62


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v: whole components, as long as the longest."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), wide.alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(~bad)
    whole = F.transform("x", lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x * SCALE))).cast("int"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), whole.alias("v")).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.label", "m.v")
    rows = materialise(rows, "vectors")
    size = rows.agg(F.max(F.size("v")), F.min(F.size("v"))).first()
    if size[0] != size[1]:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(size[0]) - F.size("v"))))
    return rows


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids * centroids).sum(1) - 2 * (x @ centroids.T), axis=1)


def fit(sample: np.ndarray, k: int) -> np.ndarray:
    """K-means by Lloyd's rounds from evenly spaced rows of the sample; a centroid that loses all rows stays."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centroids = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        own = nearest(sample, centroids)
        sums, count = np.zeros_like(centroids), np.bincount(own, minlength=k)
        np.add.at(sums, own, sample)
        centroids[count > 0] = sums[count > 0] / count[count > 0, None]
    return centroids


def matrix(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1 if len(flat) else 0).astype(dtype)


def dealt(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds list, the nearest centroid, and the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"))
                own = nearest(x, centroids)
                away = np.sqrt(((x - centroids[own]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(away)], ["vec_id", "label", "v", "list", "away"])

    return rows.mapInArrow(tidy(run), "vec_id long, label long, v array<int>, list int, away double")


class Index:
    """Inverted lists: their rows by (list, block), and on the driver K centroids, radii, sizes and numbers of blocks."""

    def __init__(self, rows: DataFrame):
        n = rows.count()
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
        x = matrix(sample)
        self.centroids = fit(x, max(1, min(LISTS, len(x), math.isqrt(n) // 2)))
        found = materialise(dealt(rows, self.centroids), "dealt")
        facts = {r.list: r for r in found.groupBy("list").agg(F.max("away").alias("radius"), F.count("*").alias("rows")).collect()}  # one row for each centroid
        k = len(self.centroids)
        self.radius = np.array([facts[c].radius if c in facts else 0.0 for c in range(k)])
        self.rows = np.array([facts[c].rows if c in facts else 0 for c in range(k)])
        self.blocks = np.maximum(1, -(-self.rows // BLOCK))
        cut = F.pmod(F.xxhash64("vec_id"), F.array(*map(F.lit, self.blocks.tolist()))[F.col("list")])
        self.table = materialise(found.select("list", cut.cast("int").alias("block"), "vec_id", "label", "v"), "lists")


def bounds(x: np.ndarray, centroids: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score that each list may hold for each anchor; rounding errors are allowed for."""
    middle, reach = x @ centroids.T, np.sqrt((x * x).sum(1))[:, None] * radius
    slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
    return np.ceil(middle - reach - slack), np.floor(middle + reach + slack)


VISIT = "list int, block int, deal int, anchor long, label long, v array<int>, windows array<struct<slot:int,low:bigint,high:bigint,kth:bigint>>"


def visits(requests: DataFrame, index: Index, anchors: int, later: bool) -> DataFrame:
    """A row for each block that an anchor visits. First those of the lists with the highest bounds, up to about `FIRST` rows; later all others that a kth score does not rule out."""
    centroids, radius, size, blocks = index.centroids, index.radius, index.rows, index.blocks
    deals = max(1, -(-anchors // VISITORS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                x = matrix(part.column("v"))
                low, high = bounds(x, centroids, radius)
                windows = part.column("windows").to_pylist()
                anchor, each = [], []
                for i, own in enumerate(windows):
                    open_, first = np.zeros(len(size), bool), np.zeros(len(size), bool)
                    for w in own:
                        may = (size > 0) & (high[i] >= w["low"]) & (low[i] <= w["high"])
                        top = np.minimum(high[i], w["high"])
                        order = np.argsort(-top, kind="stable")
                        order = order[may[order]]
                        seen = np.cumsum(size[order]) - size[order]
                        first[order[seen < FIRST]] = True
                        open_ |= may & (top >= w["kth"])
                    chosen = np.flatnonzero(open_ & ~first if later else first)
                    each.append(chosen)
                    anchor.append(np.full(len(chosen), i))
                lists, rows = np.concatenate(each), np.concatenate(anchor)
                many = blocks[lists]
                rows, lists = np.repeat(rows, many), np.repeat(lists, many)
                block = np.arange(len(lists)) - np.repeat(np.cumsum(many) - many, many)
                taken = part.take(pa.array(rows))
                deal = taken.column("anchor").to_numpy() // ANCHORS % deals
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(block, pa.int32()), pa.array(deal, pa.int32()), *(taken.column(c) for c in ("anchor", "label", "v", "windows"))], ["list", "block", "deal", "anchor", "label", "v", "windows"])

    return requests.select("anchor", "label", "v", "windows").mapInArrow(tidy(run), VISIT)


FOUND = "anchor long, slot int, score long, vec_id long"


def _meet(same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows by (list, block, deal), in each the block's rows by vec_id and then its visitors: the best rows of the block for each visitor's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None

        def best(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, labels, x = block
            y = matrix(part.column("v"), x.dtype)
            exact = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(1, x.shape[1]) < 1 << 53
            score = (y @ x.T).astype(np.int64) if exact else y.astype(np.int64) @ x.T.astype(np.int64)
            anchor = part.column("anchor").to_numpy()
            fits = labels == part.column("label").to_numpy()[:, None]
            fits = fits & (ids != anchor[:, None]) if same else ~fits
            windows = part.column("windows").to_pylist()
            out: list[list[np.ndarray]] = [[], [], [], []]
            for slot in range(max(map(len, windows))):
                own = [w[slot] if slot < len(w) else {"slot": -1, "low": 1, "high": 0, "kth": 0} for w in windows]
                low = np.array([max(w["low"], w["kth"]) for w in own])[:, None]
                high = np.array([w["high"] for w in own])[:, None]
                left = np.where(fits & (score >= low) & (score <= high), score, np.iinfo(np.int64).min)
                number = np.array([w["slot"] for w in own], np.int32)
                rows = np.flatnonzero((left > np.iinfo(np.int64).min).any(1))
                left = left[rows]
                for _ in range(TOP):
                    at = left.argmax(1)  # the first of equal scores has the smallest vec_id
                    value = left[np.arange(len(left)), at]
                    more = value > np.iinfo(np.int64).min
                    rows, left, at, value = rows[more], left[more], at[more], value[more]
                    if not len(rows):
                        break
                    for column, values in zip(out, (anchor[rows], number[rows], value, ids[at]), strict=True):
                        column.append(values)
                    left[np.arange(len(left)), at] = np.iinfo(np.int64).min
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["anchor", "slot", "score", "vec_id"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("list", "block", "deal")], axis=1)
            visitor = batch.column("windows").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1) | (visitor[1:] != visitor[:-1])]) if len(keys) else []
            for start, stop in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                part = batch.slice(start, stop - start)
                if key != (now := tuple(keys[start])):
                    key, held, block = now, [], None
                if not visitor[start]:
                    held.append(part)
                    continue
                if block is None and held:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    block = whole["vec_id"].to_numpy(), whole["label"].to_numpy(), matrix(whole["v"].combine_chunks())
                if block:
                    for at in range(0, part.num_rows, 256):
                        yield from best(part.slice(at, 256))

    return tidy(run)


def met(asked: DataFrame, index: Index, anchors: int, same: bool) -> DataFrame:
    """(anchor, slot, score, vec_id): what each visit finds."""
    deals = max(1, -(-anchors // VISITORS))
    rows = index.table.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    wanted = asked.select("list", "block", "deal").distinct()
    rows = rows.join(wanted, ["list", "block", "deal"], "left_semi").select("list", "block", "deal", "vec_id", "label", "v")
    both = rows.unionByName(asked, allowMissingColumns=True)
    both = both.repartition("list", "block", "deal").sortWithinPartitions("list", "block", "deal", F.col("windows").isNotNull(), "vec_id", "anchor")
    return both.select("list", "block", "deal", "vec_id", "label", "v", "anchor", "windows").mapInArrow(_meet(same), FOUND)


def first_of(found: DataFrame) -> DataFrame:
    """The `TOP` first rows of each request, with their rank; each task keeps no more than that before the shuffle."""
    w = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP)


def search(requests: DataFrame, index: Index, anchors: int, same: bool, name: str) -> DataFrame:
    """(anchor, slot, score, vec_id, rank): the first rows of every window of every request."""
    once = materialise(first_of(met(materialise(visits(requests, index, anchors, False), f"{name}-visits"), index, anchors, same)), f"{name}-first")
    kth = once.where(F.col("rank") == TOP).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("known"))
    bounded = requests.join(kth, "anchor", "left").withColumn(
        "windows", F.transform("windows", lambda w: w.withField("kth", F.coalesce(F.col("known")[w["slot"]], F.lit(LEAST).cast("long"))))
    )
    more = materialise(visits(bounded, index, anchors, True), f"{name}-visits")
    return first_of(once.drop("rank").union(met(more, index, anchors, same)))


def mine(rows: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and positive, the first rows of other labels whose score is at least 80 % of the positive's and no more than it."""
    rows = materialise(usable(rows), "usable")
    index = Index(rows)
    anchors = rows.where(F.col("vec_id") % ANCHORS == 0).select(F.col("vec_id").alias("anchor"), "label", "v")
    count = anchors.count()
    window = lambda slot, low, high: F.struct(slot.cast("int").alias("slot"), low.cast("long").alias("low"), high.cast("long").alias("high"), F.lit(LEAST).cast("long").alias("kth"))
    every = anchors.withColumn("windows", F.array(window(F.lit(0), F.lit(LEAST), F.lit(MOST))))
    positives = materialise(search(every, index, count, True, "positives"), "positives")
    # 80 p <= 100 n <= 100 p, and n whole
    own = positives.where("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(window(F.col("rank"), F.expr(f"(score * {LOW} + 99) div 100"), F.col("score")))).alias("windows"))
    negatives = search(anchors.join(own, "anchor"), index, count, False, "negatives")
    both = negatives.select("anchor", "slot", F.col("score").alias("negative_score"), F.col("vec_id").alias("negative_id"), "rank")
    both = both.join(positives.select("anchor", F.col("rank").alias("slot"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), ["anchor", "slot"])
    return both.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
