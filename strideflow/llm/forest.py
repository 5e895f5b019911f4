"""Quality rules: rule statistics of each text, and an isolation forest over them.

The rule statistics are counted over whole texts on bytes with numpy. An isolation forest is fitted on the statistics of
labelled rows (a bounded sample, `MAX_FIT`): in a tree each node splits a random statistic at a random value, and a row
that is parted from the others after few splits is anomalous. The score is 2^(-mean path length / c(sample)). The threshold
on it is calibrated from the same labelled rows: the one with the highest balanced accuracy for label 1 against label 0.
The forest has at most `TREES` x 2 x `SUBSAMPLE` nodes, so what is sent to the executors has a fixed bound.

A row that fails the base rules is never kept. Null text has no words, so it fails. Without labelled rows of both kinds
the forest is not fitted, and the base rules decide. Repeated rows each get their own result; null doc_id stays null.
Only doc_id and text are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.llm import textops
from strideflow.llm.storage import tidy

MAX_FIT = 4096
TREES = 128
SUBSAMPLE = 256
SEED = 20
MIN_WORDS = 10
REPEAT_WINDOW = 5
REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHAPES = ("n_upper", "n_lower", "n_marks", "n_same_words")


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_IS_SYMBOL = _flags(SYMBOLS)
_IS_UPPER = _flags(bytes(range(65, 91)))
_IS_LOWER = _flags(bytes(range(97, 123)))
_IS_MARK = _flags(b"!?")
_IS_LEAD = np.ones(256, bool)
_IS_LEAD[0x80:0xC0] = False  # continuation bytes: a code point counts once


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _count_at(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


def _repeated_within(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: whether its (doc, value) occurs again, and whether it occurred before."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
    again, before = np.zeros(len(order), bool), np.zeros(len(order), bool)
    again[order] = same[1:] | same[:-1]
    before[order] = same[:-1]  # lexsort is stable: the first of a run is the earliest
    return again, before


def _lines(w: textops.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each line that has a word, over its bytes, and its text."""
    data, offsets = w.data, w.text_start
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(breaks + 1, offsets[:-1][offsets[:-1] < len(data)])
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(data))
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10))
    with_word = np.searchsorted(w.start, ends, "left") > np.searchsorted(w.start, starts, "left")
    starts, ends = starts[with_word], ends[with_word]
    line = textops.Words(data, offsets, starts, ends, np.searchsorted(offsets, starts, "right") - 1, starts)
    return line.hashes(), line.doc


def statistics(w: textops.Words) -> dict[str, np.ndarray]:
    """Counts for each text of a chunk that was mapped with textops.IDENTITY."""
    n, offsets, data = len(w.text_start) - 1, w.text_start, w.data
    hashes = w.hashes()
    out = {"n_words": np.diff(w.first).astype(np.int64)}
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    in_word = np.cumsum(inside[:-1]).astype(bool)
    out["word_chars"] = _per_text(in_word & _IS_LEAD[data], offsets)
    out["n_symbols"] = _per_text(_IS_SYMBOL[data], offsets)
    line, line_doc = _lines(w)
    out["n_dup_lines"] = _count_at(line_doc[_repeated_within(line_doc, line)[1]], n)
    window, at = textops.windows(w, hashes, REPEAT_WINDOW)
    twice = _repeated_within(w.doc[at], window)[0]
    covered = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(covered, at[twice], 1)
    np.add.at(covered, at[twice] + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = _count_at(w.doc[np.cumsum(covered[:-1]) > 0], n)
    out |= {k: _per_text(f[data], offsets) for k, f in (("n_upper", _IS_UPPER), ("n_lower", _IS_LOWER), ("n_marks", _IS_MARK))}
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (w.doc[1:] == w.doc[:-1])) if len(hashes) > 1 else np.zeros(0, np.int64)
    out["n_same_words"] = _count_at(w.doc[same], n)
    return out


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios, so that a clean text's length is no anomaly."""
    words = np.maximum(s["n_words"], 1).astype(np.float64)
    chars = np.maximum(s["word_chars"], 1).astype(np.float64)
    cased = np.maximum(s["n_upper"] + s["n_lower"], 1).astype(np.float64)
    return np.column_stack(
        [
            s["n_symbols"] / chars,
            s["n_symbols"] / words,
            s["n_upper"] / cased,
            s["n_marks"] / words,
            s["n_same_words"] / words,
        ]
    )


class IsolationForest:
    """Trees as flat arrays: split statistic, split value, children, and the path length that a leaf stands for."""

    def __init__(self, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(self.size, 2)))))
        self.trees = [self._tree(x[rng.choice(len(x), self.size, replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def expected(n: float) -> float:
        """Mean path length of an unsuccessful search among n rows."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def _tree(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        column, value, left, length = [], [], [], []

        def node() -> int:
            for part in (column, value, left, length):
                part.append(0)
            return len(column) - 1

        stack = [(node(), x, 0)]
        while stack:
            at, rows, depth = stack.pop()
            low, high = rows.min(0), rows.max(0)
            splits = np.flatnonzero(high > low)
            if depth >= self.depth or len(rows) <= 1 or not len(splits):
                column[at], length[at] = -1, depth + self.expected(len(rows))
                continue
            k = int(rng.choice(splits))
            cut = rng.uniform(low[k], high[k])
            column[at], value[at] = k, cut
            below = rows[:, k] < cut
            children = (node(), node())
            left[at] = children[0]
            stack += [(children[0], rows[below], depth + 1), (children[1], rows[~below], depth + 1)] if below.any() else [(children[0], rows[:1], depth + 1), (children[1], rows, depth + 1)]
        return np.array(column), np.array(value, float), np.array(left), np.array(length, float)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for column, value, left, length in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                c = column[at]
                inner = c >= 0
                go = left[at] + (x[np.arange(len(x)), np.maximum(c, 0)] >= value[at])
                at = np.where(inner, go, at)
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(self.expected(self.size), 1e-9))


def calibrate(scores: np.ndarray, labels: np.ndarray) -> float:
    """The score above which a row is anomalous: the cut with the highest balanced accuracy."""
    order = np.argsort(scores)
    s, good = scores[order], labels[order] == 1
    kept_good = np.cumsum(good) / max(good.sum(), 1)
    kept_bad = np.cumsum(~good) / max((~good).sum(), 1)
    gain = kept_good - kept_bad
    gain[:-1][s[1:] == s[:-1]] = -1  # no cut between equal scores
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    k = int(best[-1])
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def count_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, counts) of each row."""
    names = COUNTS + SHAPES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, w in textops.chunks(batch.column(1), textops.IDENTITY):
                s = statistics(w)
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], *(pa.array(s[k]) for k in names)], ["doc_id", *names])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in names)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), schema)


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_FIT) -> tuple[IsolationForest, float] | None:
    """Forest and threshold from at most `limit` labelled rows, drawn by a hash of doc_id."""
    drawn = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    ids = {r.doc_id: r.label for r in drawn.collect()}
    if len(set(ids.values())) < 2:
        return None
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i,) for i in ids], "wanted_id long")  # at most `limit` rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("wanted_id"), "left_semi")
    rows = sorted(count_statistics(texts).dropDuplicates().limit(2 * limit).collect(), key=tuple)
    if not rows:
        return None
    s = {k: np.array([r[k] for r in rows], np.int64) for k in COUNTS + SHAPES}
    keep = ~base_failed(s)
    label = np.array([ids[r.doc_id] for r in rows])
    x = features(s)
    if len(set(label[keep])) < 2:
        return None
    forest = IsolationForest(x)
    return forest, calibrate(forest.score(x[keep]), label[keep])


def verdict(model: tuple[IsolationForest, float] | None) -> Callable[[textops.Words], tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """For a chunk: statistics, base_failed, anomaly score and kept."""

    def judge(w: textops.Words) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        s = statistics(w)
        failed = base_failed(s)
        score = model[0].score(features(s)) if model else np.zeros(len(failed))
        return s, failed, score, ~failed & (score <= model[1] if model else True)

    return judge


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the five counts, base_failed, anomaly, kept) of each row."""
    judge = verdict(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, w in textops.chunks(batch.column(1), textops.IDENTITY):
                s, failed, score, kept = judge(w)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], *(pa.array(s[k]) for k in COUNTS), pa.array(failed), pa.array(score), pa.array(kept)],
                    ["doc_id", *COUNTS, "base_failed", "anomaly", "kept"],
                )

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, anomaly double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns."""
    judge = verdict(fit(docs, labels))
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, w in textops.chunks(batch.column(column), textops.IDENTITY):
                yield batch[rows].filter(pa.array(judge(w)[3]))

    return docs.mapInArrow(tidy(run), docs.schema)
