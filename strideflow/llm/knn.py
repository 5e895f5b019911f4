"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent-semantic space.

A text's terms are shapes of its words (upper-case runs as A, other letters as a, digits as 0, other characters as they are),
pairs of adjacent shapes, and words that repeat the word before them, hashed to `TERMS` buckets; the weight of a term is
the square root of its share of the words times its inverse document frequency. A truncated SVD of the labelled rows'
matrix gives the latent space. The labelled vectors (at most `MAX_FIT` x `RANK`) are sent to every executor, which computes
the exact cosine products of every document with all of them, block by block, and lets the `NEIGHBOURS` nearest vote.

Labels are learned from a bounded sample of rows outside the held-out fold, drawn by a hash of doc_id. A text without words, or
without a term of the space, gets the share of label 1 in the sample; with no labelled rows every text gets 0.5. Neighbours
at equal similarity are taken in order of doc_id. Repeated rows each get their own result, and null doc_id stays null.
Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow.llm import textops
from strideflow.llm.storage import tidy

FOLDS, HELD_OUT = 4, 2
MAX_FIT = 2048
TERMS = 4096
RANK = 32
NEIGHBOURS = 15
BLOCK = 512
THRESHOLD = 0.7
SEED = 3

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = ord("A")
_SHAPE[97:123] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[48:58] = ord("0")
_RUNS = np.zeros(256, bool)
_RUNS[[ord("A"), ord("a"), ord("0")]] = True
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def term_counts(w: textops.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) for each term of each text of a chunk that was mapped with LOWER's inverse kept: IDENTITY; and words per text."""
    shape = _SHAPE[w.data]
    keep = np.ones(len(shape), bool)
    keep[1:] = ~((shape[1:] == shape[:-1]) & _RUNS[shape[1:]])
    keep[w.start] = True
    place = np.zeros(len(shape) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    short = textops.Words(shape[keep], place[w.text_start], place[w.start], place[w.end], w.doc, w.first)
    shapes = short.hashes()
    lower = textops.Words(textops.LOWER[w.data], w.text_start, w.start, w.end, w.doc, w.first).hashes()
    n = len(shapes)
    same_text = np.flatnonzero(w.doc[1:] == w.doc[:-1]) if n > 1 else np.zeros(0, np.int64)
    repeat = same_text[lower[same_text + 1] == lower[same_text]] + 1 if n > 1 else same_text
    pair = textops.mix(shapes[same_text] * _PAIR + shapes[same_text + 1])
    terms = np.concatenate([shapes, pair]) % np.uint64(TERMS - 1) + np.uint64(1)
    rows = np.concatenate([w.doc, w.doc[same_text], w.doc[repeat]])
    key = rows * TERMS + np.concatenate([terms.astype(np.int64), np.zeros(len(repeat), np.int64)])
    found, count = np.unique(key, return_counts=True)
    return found // TERMS, found % TERMS, count, np.diff(w.first)


@dataclass
class Space:
    """Inverse document frequencies with the projection, and the labelled vectors with their labels."""

    projection: np.ndarray  # (TERMS, RANK)
    vectors: np.ndarray  # (labelled, RANK), of length 1
    labels: np.ndarray
    prior: float

    def project(self, w: textops.Words) -> np.ndarray:
        row, term, count, words = term_counts(w)
        weight = np.sqrt(count / np.maximum(words, 1)[row]).astype(np.float32)
        out = np.zeros((len(words), self.projection.shape[1]), np.float32)
        bounds = np.searchsorted(row, np.arange(len(words) + 1))
        for k in range(len(words)):
            part = slice(bounds[k], bounds[k + 1])
            out[k] = weight[part] @ self.projection[term[part]]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def score(self, vectors: np.ndarray) -> np.ndarray:
        out = np.full(len(vectors), self.prior)
        if not len(self.vectors):
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for at in range(0, len(vectors), BLOCK):
            block = vectors[at : at + BLOCK]
            near = block @ self.vectors.T
            top = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1)
            weight = np.maximum(np.take_along_axis(near, top, 1), 0.0).astype(np.float64) ** 4
            total = weight.sum(1)
            some = np.flatnonzero(total > 1e-9)
            out[at + some] = (weight * self.labels[top]).sum(1)[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def build(column: pa.Array, labels: np.ndarray) -> Space:
    """The space of labelled texts."""
    matrix = np.zeros((len(column), TERMS), np.float32)
    for rows, w in textops.chunks(column, textops.IDENTITY):
        row, term, count, words = term_counts(w)
        matrix[row + rows.start, term] = np.sqrt(count / np.maximum(words, 1)[row])
    if not len(column):
        return Space(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    idf = np.log((len(column) + 1) / ((matrix > 0).sum(0) + 1)).astype(np.float32) + np.float32(0.05)
    matrix *= idf
    rank = min(RANK, *matrix.shape)
    basis = np.linalg.qr(matrix.T @ np.random.default_rng(SEED).standard_normal((len(column), rank + 8)).astype(np.float32))[0]
    for _ in range(4):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    _, _, right = np.linalg.svd(matrix @ basis, full_matrices=False)
    axes = basis @ right[:rank].T
    vectors = matrix @ axes
    length = np.linalg.norm(vectors, axis=1)
    some = length > 1e-9
    return Space((idf[:, None] * axes).astype(np.float32), (vectors[some] / length[some, None]).astype(np.float32), labels[some], float(labels.mean()))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % FOLDS == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_FIT) -> Space:
    """A space from at most `limit` labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    drawn = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id")
        .limit(limit)
    )
    ids = {r.doc_id: r.label for r in drawn.collect()}
    wanted = spark.createDataFrame([(i,) for i in ids], "wanted_id long")  # at most `limit` rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("wanted_id"), "left_semi")
    rows = sorted(texts.dropDuplicates(["doc_id"]).collect(), key=lambda r: r.doc_id) if ids else []
    return build(pa.array([r.text for r in rows], pa.large_string()), np.array([ids[r.doc_id] for r in rows], float))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    space = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, w in textops.chunks(batch.column(1), textops.IDENTITY):
                score = space.score(space.project(w))
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.array(score)], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
