"""N-gram Jaccard join by token-combination prefixes, and the components of its links.

A document's tokens are the hashes of its distinct five-word shingles. Two documents link when 100 * intersection >= 80 *
union. All tokens have one global order: tokens of the rare class first, then those of the frequent class, each by hash. A token is
of the frequent class when its counter in a sketch of the whole corpus is high; the sketch never counts too little, so a rare
token is in at most `threshold` documents.

Documents with equal sets are one unit from the start (their rows are grouped by a 128-bit hash of the set), so copies cost no pairs.
With overlap a(x) = ceil(0.8 |x|) at least, the first L common tokens of a link are within the first |x| - a(x) + L tokens of both.
Hence, if the first common token is rare, both units have it among their first |x| - a(x) + 1 tokens, and single rare
tokens are indexed there with their places: what follows the place bounds the overlap. Otherwise all common tokens are frequent, so a unit has at
least a(x) frequent ones, and only such units have keys of the frequent class: with prefixes extended to L = (k - 1) g + 1 common tokens, and frequent
tokens dealt to g classes by hash, k of the common tokens fall in one class, so combinations of k tokens of one class are indexed.
g grows with the size, by bands of sizes from 2^b to 2^(b+1); a link is found in the band of its smaller unit, so a unit
also uses the rules of the band below while it can link with it. k is 2, and 1 for links of units of at most `SMALL` tokens. Two units whose common
tokens are all frequent overlap in no more than the lesser number f of frequent tokens, and a link overlaps in 4 / 9 of the two sizes at least; so
9 min(f(x), f(y)) >= 4 (|x| + |y|). This drops the pairs that a common passage makes, and those of copies that are altered too much.

The units of a key are not paired with each other. First each is verified against the key's pivot (for frequent keys the unit
with the greatest 9 f - 4 |x|, which the bound lets link with most others), and the links give components. Where all units of a key are then in one component, the key is done. In the other
keys units of different components that pass the bounds are verified against each other. So no link between different components is lost, and no pair
within a component is made after the first round. Before sets are compared, a
parity sketch bounds the symmetric difference of a pair from below (each token that one side alone has flips one of `PARITY` bits), which
rejects most pairs that share a passage only; units of more than `WIDE_FROM` tokens have a second, wider sketch. Sets of the units to be
verified are built again from their texts, which a bit map of fixed size selects in the scan.

Null and empty texts and texts without words have no tokens and no links; fewer than five words make one token of the whole
sequence. Rows with equal doc_id are one document that links if any of its rows does; null doc_id never links. Only doc_id and text
are read. Hashes have 64 bits.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow.llm import textops
from strideflow.llm.graph import connected_components
from strideflow.llm.storage import materialise, shuffle_partitions, tidy

SHINGLE = 5
PERCENT = 80
SMALL = 32
SLICES = 64
FULL = 255
PARITY, WIDE, WIDE_FROM = 1024, 8192, 960
TOP = np.uint64(1 << 63)


def overlap(n: np.ndarray | int) -> np.ndarray | int:
    """The least intersection that a set of n tokens needs to link with any set."""
    return (PERCENT * n + 99) // 100


def shingles(w: textops.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Token and text of each shingle of a chunk, repeated ones included."""
    hashes = w.hashes()
    value, at = textops.windows(w, hashes, size)
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if not len(short):
        return value, w.doc[at]
    alone = np.array([textops.sequence_hash(hashes[w.first[k] : w.first[k + 1]]) for k in short], np.uint64)
    doc = np.concatenate([w.doc[at], short])
    order = np.argsort(doc, kind="stable")
    return np.concatenate([value, alone])[order], doc[order]


def sketch(tables: DataFrame, bits: int, of: str, at_least: int) -> np.ndarray:
    """A bit map of 2^bits bits: whether at least `at_least` values (or `FULL` in one task) fall on a counter. `of`: 'text' counts shingles, 'id' values of a long column.

    Each task counts in its own array and sends it in slices, sparse where that is shorter; slices are added up as they stream in.
    The driver gets the bit map alone, of 2^bits / 8 bytes.
    """
    width = 1 << bits
    part = max(1, width // SLICES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(width, np.uint8)  # up to FULL
        any_value = False
        for batch in batches:
            if of == "text":
                found = (shingles(w)[0] >> np.uint64(64 - bits) for _, w in textops.chunks(batch.column(0)))
            else:
                found = iter([textops.mix(np.asarray(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)])
            for values in found:
                any_value |= len(values) > 0
                place, n = np.unique(values.astype(np.int64), return_counts=True)
                counters[place] = np.minimum(counters[place].astype(np.int64) + n, FULL)
        if not any_value:
            return
        for k in range(0, width, part):
            piece = counters[k : k + part]
            place = np.flatnonzero(piece)
            if not len(place):
                continue
            sparse = 5 * len(place) < len(piece)
            body = place.astype("<u4").tobytes() + piece[place].tobytes() if sparse else piece.tobytes()
            yield pa.RecordBatch.from_pylist([{"slice": k // part, "sparse": sparse, "body": zlib.compress(body, 1)}], schema=packed)

    packed = pa.schema([("slice", pa.int32()), ("sparse", pa.bool_()), ("body", pa.binary())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                k, sparse, body = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), zlib.decompress(batch.column(2)[i].as_py())
                sums = total.setdefault(k, np.zeros(part, np.int64))
                n = len(body) // 5
                place = np.frombuffer(body, "<u4", n) if sparse else slice(None)
                value = np.frombuffer(body, np.uint8, offset=4 * n if sparse else 0).astype(np.int64)
                sums[place] += np.where(value == FULL, at_least, value)
        for k, sums in total.items():
            bits_set = np.packbits(sums >= at_least).tobytes()
            yield pa.RecordBatch.from_pylist([{"slice": k, "sparse": False, "body": bits_set}], schema=packed)

    schema = "slice int, sparse boolean, body binary"
    slices = tables.mapInArrow(tidy(count), schema).repartition(min(SLICES, shuffle_partitions(tables.sparkSession)), "slice").mapInArrow(tidy(add), schema)
    out = np.zeros(width, bool)
    for r in slices.collect():
        out[r.slice * part : (r.slice + 1) * part] = np.unpackbits(np.frombuffer(r.body, np.uint8), count=part).astype(bool)
    return np.packbits(out)


def bit(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


_RULE = np.uint64(0xA24BAED4963EE407)


def _combinations(tokens: np.ndarray, classes: int, rule: int) -> np.ndarray:
    """A key for each pair of tokens of one class."""
    group = (textops.mix(tokens ^ _RULE) % np.uint64(classes)).astype(np.int64)
    order = np.lexsort((tokens, group))
    t, g = tokens[order], group[order]
    out = []
    for step in range(1, len(t)):
        same = g[step:] == g[:-step]
        if not same.any():
            break
        out.append(textops.mix(t[:-step][same] * _RULE + textops.mix(t[step:][same]) + np.uint64(rule)))
    return np.concatenate(out) if out else tokens[:0]


def prefix_keys(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one document under single rare tokens, and keys under the frequent class. tokens: distinct, in order; the top bit marks the frequent class."""
    n = len(tokens)
    rare = int(np.searchsorted(tokens, TOP))
    loose = n - overlap(n)
    singles = tokens[: min(loose + 1, rare)]
    if rare > loose:  # a link of frequent tokens alone has at least overlap(n) of them
        return singles, tokens[:0]
    frequent = []
    if n <= SMALL * 100 / PERCENT:
        frequent.append(textops.mix(tokens[rare : loose + 1] + _RULE))
    if n > SMALL:
        band = n.bit_length() - 1
        for k in (band, band - 1):
            low = max(1 << k, SMALL + 1)
            high = (2 << k) - 1
            if high < SMALL + 1 or n * PERCENT > high * 100 and k != band:
                continue
            classes = max(2, (1 << k) // 8)
            if overlap(low) < classes + 1:
                raise AssertionError("a band's links have to share more tokens than there are classes")
            frequent.append(_combinations(tokens[rare : loose + classes + 1], classes, k))
    return singles, np.unique(np.concatenate(frequent)) if frequent else tokens[:0]


def ordered_tokens(value: np.ndarray, frequent: np.ndarray, bits: int) -> np.ndarray:
    """Tokens with their class in the top bit, so that their numeric order is the global order."""
    return np.where(bit(frequent, (value >> np.uint64(64 - bits)).astype(np.int64)), value | TOP, value & ~TOP)


def parity(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Bits in 64-bit words: whether an odd number of tokens falls on each."""
    return np.packbits(np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).view(np.uint64)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def prefixes(docs: DataFrame, frequent: np.ndarray, bits: int) -> DataFrame:
    """For each row: its number and doc_id, the size and hash of its set, its rare tokens' number, its keys and its parity sketches."""

    def lists(parts: list[np.ndarray]) -> pa.Array:
        offsets = np.cumsum([0, *map(len, parts)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _long(np.concatenate(parts) if parts else np.zeros(0, np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for rows, w in textops.chunks(batch.column(1)):
                value, doc = shingles(w)
                value = ordered_tokens(value, frequent, bits)
                bounds = np.searchsorted(doc, np.arange(rows.stop - rows.start + 1))
                sets = [np.unique(value[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                keys = [prefix_keys(t) if len(t) else (t, t) for t in sets]
                count = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(number, number + count)), batch.column(0)[rows], pa.array([len(t) for t in sets], pa.int64()),
                        _long(np.array([textops.mix(t & ~TOP).sum(dtype=np.uint64) for t in sets], np.uint64)), _long(np.array([textops.mix((t & ~TOP) ^ _RULE).sum(dtype=np.uint64) for t in sets], np.uint64)),
                        pa.array([int(np.searchsorted(t, TOP)) for t in sets], pa.int64()), lists([k[0] for k in keys]), lists([k[1] for k in keys]),
                        lists([parity(t, PARITY) for t in sets]), lists([parity(t, WIDE) if len(t) > WIDE_FROM else t[:0] for t in sets]),
                    ],
                    COLUMNS,
                )
                number += count

    return docs.mapInArrow(tidy(run), "row long, doc_id long, n long, h1 long, h2 long, rare long, rare_keys array<long>, frequent_keys array<long>, parity array<long>, wide array<long>")


COLUMNS = ["row", "doc_id", "n", "h1", "h2", "rare", "rare_keys", "frequent_keys", "parity", "wide"]


def _rare_stars(postings: DataFrame) -> DataFrame:
    """(key, pivot, doc, pivot_n, n, pivot_at, at) for keys with more than one unit: the first one of each run is the pivot. Runs are short."""
    names = ["key", "pivot", "doc", "pivot_n", "n", "pivot_at", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, *own = (batch.column(k).to_numpy() for k in range(4))
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            lead = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            pivot = [x[lead] for x in own]
            others = ~first
            if last is not None and key[0] == last[0]:  # the run goes on from the batch before
                run_length = int(np.searchsorted(np.cumsum(first), 2)) if first.sum() > 1 else len(key)
                for x, value in zip(pivot, last[1:], strict=True):
                    x[:run_length] = value
                others[0] = True
            last = (key[-1], *(x[-1] for x in pivot))
            keep = np.flatnonzero(others & (own[0] != pivot[0]))
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, pivot[0], own[0], pivot[1], own[1], pivot[2], own[2])], names)

    ordered = postings.repartition(shuffle_partitions(postings.sparkSession), "key").sortWithinPartitions("key", F.xxhash64("doc"), "doc")
    return ordered.mapInArrow(tidy(run), ", ".join(f"{k} long" for k in names))


def _frequent_stars(postings: DataFrame) -> DataFrame:
    """The same where a key may hold a third of all units: minima are pre-aggregated, and a hot key's join can be split. at: f."""
    least = F.min(F.struct((4 * F.col("n") - 9 * F.col("at")).alias("first"), F.xxhash64("doc").alias("h"), F.col("doc").alias("pivot"), F.col("n").alias("pivot_n"), F.col("at").alias("pivot_at")))
    pivots = postings.groupBy("key").agg(least.alias("p"), F.count("*").alias("c")).where("c > 1")
    joined = postings.join(pivots.select("key", "p.pivot", "p.pivot_n", "p.pivot_at"), "key")
    return joined.where("doc <> pivot").select("key", "pivot", "doc", "pivot_n", "n", "pivot_at", "at")


def _compatible(a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _bounded(rare: bool, a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Whether two units (size, at) that share a key may link because of it: by the tokens from the common one on, or by the frequent ones."""
    (n, i), (m, j) = (tuple(map(F.col, x)) for x in (a, b))
    most = F.least(n - i, m - j) if rare else F.least(i, j)
    return most * (100 + PERCENT) >= (n + m) * PERCENT


def possible(pairs: DataFrame, sketches: DataFrame, column: str) -> DataFrame:
    """The pairs (a, b) whose parity sketches allow a link: |x| + |y| - 2 overlap is at least the number of bits that differ."""
    side = lambda k: sketches.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col(column).alias(f"p_{k}"))
    differ = F.aggregate(F.zip_with("p_a", "p_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # 100 o >= 80 u with o + u = |x| + |y|, so the difference u - o is at most 20 / 180 of the sum
    comparable = F.size("p_a") == F.size("p_b")
    return both.where(~comparable | (differ * (100 + PERCENT) <= (F.col("n_a") + F.col("n_b")) * (100 - PERCENT))).select("a", "b").distinct()


def verify(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The pairs (a, b), distinct and with a < b, whose sets of shingles of `size` words link."""
    pairs = materialise(possible(pairs, sketches, "parity"), "possible")
    large = sketches.where(F.size("wide") > 0)
    wide = pairs.join(large.select(F.col("doc_id").alias("a")), "a", "left_semi").join(large.select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b")
    pairs = materialise(pairs.join(wide, ["a", "b"], "left_anti").union(possible(wide, sketches, "wide")).distinct(), "possible")
    bits = 24
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    wanted = sketch(ids, bits, "id", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            place = (textops.mix(np.asarray(ids).astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
            batch = batch.filter(pa.array(bit(wanted, place)))
            for rows, w in textops.chunks(batch.column(1)):
                value, doc = shingles(w, size)
                bounds = np.searchsorted(doc, np.arange(rows.stop - rows.start + 1))
                sets = [np.unique(value[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                offsets = np.cumsum([0, *map(len, sets)])
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _long(np.concatenate(sets) if sets else value[:0]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], tokens], ["id", "tokens"])

    sets = docs.where("doc_id IS NOT NULL").mapInArrow(tidy(run), "id long, tokens array<long>")
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        sets = sets.distinct()  # repeated rows of one document
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("both"))
    return joined.where(F.col("common") * (100 + PERCENT) >= F.col("both") * PERCENT).select("a", "b").distinct()


def _crossing(stars: DataFrame, roots: DataFrame, sketches: DataFrame, rare: bool) -> DataFrame:
    """Pairs (a, b) of units of different components that share a key which holds more than one component, and may link because of it.

    The bounds and the parity sketches are tested before a pair is emitted.
    """

    def root_of(column: str, name: str) -> DataFrame:
        return roots.select(F.col("node").alias(column), F.col("root").alias(name))

    labelled = stars.join(root_of("doc", "r"), "doc", "left").join(root_of("pivot", "p"), "pivot", "left")
    labelled = labelled.withColumns({"r": F.coalesce("r", "doc"), "p": F.coalesce("p", "pivot")})
    open_keys = materialise(labelled.where("r <> p").select("key").distinct(), "open-keys")
    still = labelled.join(open_keys, "key", "left_semi")
    pivots = still.select("key", F.col("pivot").alias("doc"), F.col("pivot_n").alias("n"), F.col("pivot_at").alias("at"), F.col("p").alias("label")).distinct()
    rest = still.select("key", "doc", "n", "at", F.col("r").alias("label")).union(pivots)
    rest = materialise(rest.join(sketches.select(F.col("doc_id").alias("doc"), "n", "parity"), ["doc", "n"]), "open-members")
    x, y = rest.alias("x"), rest.alias("y")
    differ = (F.col("x.key") == F.col("y.key")) & (F.col("x.doc") < F.col("y.doc")) & (F.col("x.label") != F.col("y.label"))
    may = _compatible("x.n", "y.n") & _bounded(rare, ("x.n", "x.at"), ("y.n", "y.at"))
    apart = sum((F.bit_count(F.col("x.parity")[k].bitwiseXOR(F.col("y.parity")[k])) for k in range(PARITY // 64)), F.lit(0))
    may &= apart * (100 + PERCENT) <= (F.col("x.n") + F.col("y.n")) * (100 - PERCENT)
    return x.join(y, differ & may).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()


def link_components(docs: DataFrame, max_bits: int = 25) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; component_id is the smallest doc_id reachable by links. The sketch has at most 2^max_bits counters."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    bits = min(max_bits, max(18, math.ceil(math.log2(max(size.rows, 1))) + 6))
    threshold = max(16, math.ceil(4 * size.chars / 5 / (1 << bits)))
    frequent = sketch(docs.select("text"), bits, "text", threshold + 1)
    table = materialise(prefixes(docs, frequent, bits), "prefixes")
    known = table.where("doc_id IS NOT NULL AND n > 0")
    reps = materialise(known.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row")).alias("m")).select("h1", "h2", F.col("m.doc_id").alias("rep"), F.col("m.row").alias("row")), "sets")
    units = materialise(known.join(reps.select("row"), "row", "left_semi"), "units")

    at = {"rare_keys": F.col("pos").cast("long"), "frequent_keys": F.col("n") - F.col("rare")}

    def postings(column: str) -> DataFrame:
        return units.select("doc_id", "n", "rare", F.posexplode(column).alias("pos", "key")).select("key", F.col("doc_id").alias("doc"), "n", at[column].alias("at"))

    sketches = units.select("doc_id", "n", "parity", "wide")
    stars = {True: materialise(_rare_stars(postings("rare_keys")), "rare-stars"), False: materialise(_frequent_stars(postings("frequent_keys")), "frequent-stars")}
    met = [s.where(_compatible("pivot_n", "n") & _bounded(rare, ("pivot_n", "pivot_at"), ("n", "at"))).select(F.least("pivot", "doc").alias("a"), F.greatest("pivot", "doc").alias("b")).distinct() for rare, s in stars.items()]
    pairs = materialise(met[0].union(met[1]).distinct(), "met")
    several = known.groupBy("doc_id").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("doc_id")  # documents with more than one set
    own = known.join(several, "doc_id", "left_semi").join(reps, ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    links = materialise(verify(pairs, docs, sketches).union(own), "links")
    roots = materialise(connected_components(links), "roots")
    more = materialise(_crossing(stars[True], roots, sketches, True).union(_crossing(stars[False], roots, sketches, False)).distinct().join(pairs, ["a", "b"], "left_anti"), "crossing")
    if not more.isEmpty():
        roots = connected_components(links.union(materialise(verify(more, docs, sketches), "links")))
    found = table.select("doc_id", "n", "h1", "h2").join(reps.select("h1", "h2", "rep"), ["h1", "h2"], "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, that of its smallest doc_id (of rows with equal doc_id the one with the least text); rows of null doc_id stay."""
    found = link_components(docs)
    others = found.where("component_id <> doc_id").select(F.col("doc_id").alias("other_id")).distinct()
    others = materialise(others, "copies")
    key = docs["doc_id"].cast("long")
    right = F.broadcast(others) if others.count() <= 1_000_000 else others
    kept = docs.join(right, key == right["other_id"], "left_anti")
    repeated = materialise(docs.select(key.alias("repeated_id")).where("repeated_id IS NOT NULL").groupBy("repeated_id").count().where("count > 1").select("repeated_id"), "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, key == repeated["repeated_id"], "left_anti")
    columns = [docs[c] for c in docs.columns]
    many = kept.join(repeated, key == repeated["repeated_id"], "left_semi").groupBy(key.alias("repeated_id"))
    least = many.agg(F.min_by(F.struct(*columns), F.struct(docs["text"], F.xxhash64(*columns))).alias("row_kept")).select("row_kept.*")
    return once.unionByName(least)
