"""Near-duplicate documents by min-max hashing.

A document's set is its distinct two-word shingles; two documents link when 100 * intersection >= 80 * union. Each of `PERMUTATIONS`
permutations of the 64-bit shingle hashes (multiplication by an odd number and addition, modulo 2^64, of hashes that are mixed already) is evaluated once for
a shingle, and both its minimum and its maximum over a set are kept: each agrees for two sets with the probability of their Jaccard similarity,
and the two together vary less than two minima would, since they seldom fail at once. So `PERMUTATIONS` evaluations give 2 * `PERMUTATIONS` values. Bands of `ROWS` values take
all minima, or all maxima, of `ROWS` permutations. At a similarity of 0.8 a band agrees with probability 0.41 and none of the 40 bands
with 7e-10, which is the chance that a link is not found (0.8 is the worst case: at 0.85 it is 4e-13).

Documents with equal sets are one unit from the start, by a 128-bit hash of the set, so copies cost no pairs. The units of a band's key are
not paired with each other. In each of `TURNS` turns a key's units are verified against one of them, drawn by a hash that is the same for all
keys, so that the bands of a group of copies give the same pairs; the links give components. Keys whose units are then all in one component are done; in the
others, those outside the component that has most units there are verified against another unit of that one in the next turn. What is left after the turns is paired, units of different
components only, after parity sketches have bounded their symmetric difference. Every candidate is confirmed on full sets; each text
is read whole. A hot key's minimum is pre-aggregated, and its join can be split by adaptive execution.

Null and empty texts and texts without words have no shingles and link with nothing; one word makes one shingle of the whole sequence.
Rows with equal doc_id are one document that links if any of its rows does; a null doc_id never links, has no component and is kept.
Only doc_id and text are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.llm import jaccard, textops
from strideflow.llm.graph import connected_components
from strideflow.llm.storage import materialise, tidy

SHINGLE = 2
PERMUTATIONS = 80
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
TURNS = 3
SEED = 7


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends."""
    rng = np.random.default_rng(SEED)
    factor, addend = rng.integers(0, 1 << 63, (2, PERMUTATIONS), dtype=np.uint64)
    return factor * np.uint64(2) + np.uint64(1), addend


def signatures(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """2 * PERMUTATIONS values of each set: minima, then maxima. tokens: those of all sets, one set after another; starts: where each begins, none empty."""
    out = np.empty((len(starts), 2 * PERMUTATIONS), np.uint64)
    for k, (factor, addend) in enumerate(zip(*permutations(), strict=True)):
        value = tokens * factor + addend
        out[:, k] = np.minimum.reduceat(value, starts)
        out[:, PERMUTATIONS + k] = np.maximum.reduceat(value, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """BANDS keys of each set; the band's number takes part."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        key = textops.mix(key + parts[:, :, k])
    return key


SETS = "row long, doc_id long, n long, h1 long, h2 long, keys array<long>, parity array<long>, wide array<long>"


def sets(docs: DataFrame) -> DataFrame:
    """For each row: its number and doc_id, the size and hash of its set, the keys of its bands, and parity sketches; the last three are empty for an empty set."""

    def lists(rows: list[np.ndarray]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), jaccard._long(np.concatenate(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        none = np.zeros(0, np.uint64)
        for batch in batches:
            for rows, w in textops.chunks(batch.column(1)):
                value, doc = jaccard.shingles(w, SHINGLE)
                bounds = np.searchsorted(doc, np.arange(rows.stop - rows.start + 1))
                own = [np.unique(value[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                size = np.array([len(t) for t in own], np.int64)
                full = np.flatnonzero(size)
                keys = [none] * len(own)
                if len(full):
                    flat = np.concatenate([own[k] for k in full])
                    for k, x in zip(full, band_keys(signatures(flat, np.cumsum(size[full]) - size[full])), strict=True):
                        keys[k] = x
                hashes = [np.array([textops.mix(t ^ salt).sum(dtype=np.uint64) for t in own], np.uint64) for salt in (np.uint64(0), jaccard._RULE)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(number, number + len(own))), batch.column(0)[rows], pa.array(size), *map(jaccard._long, hashes), lists(keys),
                        lists([jaccard.parity(t, jaccard.PARITY) if len(t) else none for t in own]), lists([jaccard.parity(t, jaccard.WIDE) if len(t) > jaccard.WIDE_FROM else none for t in own]),
                    ],
                    ["row", "doc_id", "n", "h1", "h2", "keys", "parity", "wide"],
                )
                number += len(own)

    return docs.mapInArrow(tidy(run), SETS)


def stars(postings: DataFrame, turn: int) -> DataFrame:
    """(key, pivot, doc, pivot_n, n, label, pivot_label): for keys with more than one label, its units and one of them, drawn by a hash.

    In the first turn every unit is its own label, and the draw is among all. Later it is among the units of the key's most frequent label.
    """
    drawn = F.min(F.struct(F.xxhash64("doc", F.lit(turn)).alias("h"), F.col("doc").alias("pivot"), F.col("n").alias("pivot_n"), F.col("label").alias("pivot_label"))).alias("p")
    if turn:
        labels = postings.groupBy("key", "label").agg(F.count("*").alias("c"), drawn)
        pivots = labels.groupBy("key").agg(F.max(F.struct("c", "p"))["p"].alias("p"), F.count("*").alias("labels"))
    else:
        pivots = postings.groupBy("key").agg(drawn, F.count("*").alias("labels"))
    joined = postings.join(pivots.where("labels > 1").select("key", "p.pivot", "p.pivot_n", "p.pivot_label"), "key")
    return joined.select("key", "pivot", "doc", "pivot_n", "n", "label", "pivot_label")


def relabelled(postings: DataFrame, roots: DataFrame) -> DataFrame:
    return postings.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").select("key", "doc", "n", F.coalesce("root", "doc").alias("label"))


def crossing(postings: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) of units of different labels that share a key and that their sizes and parity sketches allow to link.

    All is tested before a pair is emitted, and of the keys that a pair shares only the first emits it.
    """
    several = postings.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    units = materialise(postings.join(several, "key", "left_semi").join(sketches.select(F.col("doc_id").alias("doc"), "n", "parity", "keys"), ["doc", "n"]), "open-units")
    shared = F.filter(F.zip_with("x.keys", "y.keys", lambda a, b: F.when(a == b, a)), lambda k: k.isNotNull())
    apart = sum((F.bit_count(F.col("x.parity")[k].bitwiseXOR(F.col("y.parity")[k])) for k in range(jaccard.PARITY // 64)), F.lit(0))
    may = jaccard._compatible("x.n", "y.n") & (apart * (100 + jaccard.PERCENT) <= (F.col("x.n") + F.col("y.n")) * (100 - jaccard.PERCENT))
    differ = (F.col("x.key") == F.col("y.key")) & (F.col("x.doc") < F.col("y.doc")) & (F.col("x.label") != F.col("y.label"))
    return units.alias("x").join(units.alias("y"), differ & may & (shared[0] == F.col("x.key"))).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()


def link_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; component_id is the smallest doc_id reachable by links, and a row is kept if it is its own."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = materialise(sets(docs), "signatures")
    known = table.where("doc_id IS NOT NULL AND n > 0")
    reps = materialise(known.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row")).alias("m")).select("h1", "h2", F.col("m.doc_id").alias("rep"), F.col("m.row").alias("row")), "sets")
    units = known.join(reps.select("row"), "row", "left_semi")
    sketches = units.select("doc_id", "n", "parity", "wide", "keys")
    several = known.groupBy("doc_id").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("doc_id")  # documents with more than one set
    links = materialise(known.join(several, "doc_id", "left_semi").join(reps, ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct(), "links")
    tried, roots = None, None
    postings = units.select(F.explode("keys").alias("key"), F.col("doc_id").alias("doc"), "n", F.col("doc_id").alias("label"))
    for turn in range(TURNS):
        star = materialise(stars(postings, turn), "stars")
        met = star.where((F.col("label") != F.col("pivot_label")) & jaccard._compatible("pivot_n", "n"))
        pairs = met.select(F.least("pivot", "doc").alias("a"), F.greatest("pivot", "doc").alias("b")).distinct()
        pairs = materialise(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "met")
        if not pairs.isEmpty():
            links = links.union(materialise(jaccard.verify(pairs, docs, sketches, SHINGLE), "links"))
        tried = pairs if tried is None else tried.union(pairs)
        roots = materialise(connected_components(links), "roots")
        postings = relabelled(star, roots)
    last = materialise(crossing(postings, sketches).join(tried, ["a", "b"], "left_anti"), "crossing")
    if not last.isEmpty():
        roots = connected_components(links.union(materialise(jaccard.verify(last, docs, sketches, SHINGLE), "links")))
    found = table.select("doc_id", "n", "h1", "h2").join(reps.select("h1", "h2", "rep"), ["h1", "h2"], "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
