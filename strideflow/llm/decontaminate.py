"""Benchmark decontamination by template canonicalisation.

Texts become sequences of canonical tokens: words are stripped of ASCII punctuation at both ends and lower-cased, and
numbers, units after a number, and names (capitalised words inside a sentence) become typed placeholders that remember what they
stood for. Windows of `WINDOW` tokens of documents and benchmark items are hash-joined. On each diagonal (place in the
document less place in the item) windows whose slots are the item's own always count; of the others the largest set counts in
which equal item values map to equal document values (different ones may become equal). The counted windows that cover at least
`MIN_COVERAGE` of an item's windows make a leak; where a slot's value differs it is a re-parameterised one.

The search for the largest set is exact unless it takes more than `MAX_SEARCH` steps, which needs many values that occur often
and are altered in many ways; then the largest consistent set found so far counts.

A window needs `MIN_LITERAL` tokens that are no placeholders (in a shorter item: half of its tokens), so tables of numbers
match nothing. An item shorter than `WINDOW` makes one window of its length; one shorter than `MIN_TOKENS` matches
nothing. Null and empty texts match nothing. Rows with equal doc_id count as one document, a null doc_id gives no leak. Only
doc_id and text, item_id and text are read.

Before the join, a bit map of fixed size (2^22 bits) over the hashes of all item windows drops most document windows; a
full map only drops fewer. Item windows are broadcast when they are at most `MAX_BROADCAST` rows, else the join shuffles.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.llm import textops
from strideflow.llm.storage import materialise, tidy

WINDOW = 8
MIN_TOKENS = 4
MIN_LITERAL = 4
MIN_COVERAGE = 0.5
MAP_BITS = 22
MAX_BROADCAST = 200_000
MAX_SEARCH = 20_000
#: Units of measure that become a placeholder after a number.
UNITS = "% percent mm cm m km in inch inches ft feet foot yd yards mi mile miles mg g kg t lb lbs oz ml l liter liters litre litres gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years c f k w kw kwh v hz khz mhz ghz b kb mb gb tb px usd eur gbp dollar dollars euro euros cents mph kmh".split()

_CORE = np.ones(256, bool)
_CORE[[b for b in range(128) if not chr(b).isalnum()]] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;")] = True
NUMBER, UNIT, NAME = (np.uint64(k) for k in (1, 2, 3))


def _unit_hashes() -> np.ndarray:
    return np.unique(_word_hashes([u.encode() for u in UNITS if u != "%"]))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    column = pa.array([b" ".join(words).decode()])
    return next(iter(textops.chunks(column)))[1].hashes()


_units = _unit_hashes()


def canonical(w: textops.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical token, slot value (0 for a literal) and text of each token of a chunk mapped with IDENTITY."""
    data, n = w.data, len(w.data)
    if not len(w.start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.arange(n)
    core = _CORE[data]
    after = np.minimum.accumulate(np.where(core, place, n)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(core, place, -1))
    start, end = after[w.start], before[w.end - 1] + 1
    some = start < w.end
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    initial = np.ones(len(w.start), bool)
    initial[1:] = (w.doc[1:] != w.doc[:-1]) | _STOP[data[w.end[:-1] - 1]] | (breaks[w.start[1:]] > breaks[w.end[:-1]])
    start, end, doc, initial = start[some], end[some], w.doc[some], initial[some]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lower = textops.Words(textops.LOWER[data], w.text_start, start, end, doc, w.first).hashes()
    has_lower = np.concatenate([[0], np.cumsum(_LOWER[data])])
    first, second = data[start], data[np.minimum(start + 1, n - 1)]
    number = _DIGIT[first]
    follows = np.zeros(len(start), bool)
    follows[1:] = number[:-1] & (doc[1:] == doc[:-1])
    unit = follows & np.isin(lower, _units)
    capital = _UPPER[first] | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    name = capital & ~initial & (has_lower[end] > has_lower[start])
    kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, np.uint64(0))))
    slot = kind != 0
    return np.where(slot, textops.mix(kind), lower), np.where(slot, lower | np.uint64(1), np.uint64(0)), doc


def _windows(token: np.ndarray, slot: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first token of each window of `size` tokens with literals enough."""
    if len(token) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(token) - size + 1
    literal = np.concatenate([[0], np.cumsum(slot == 0)])
    enough = literal[size:] - literal[:n] >= min(MIN_LITERAL, (size + 1) // 2)
    at = np.flatnonzero((doc[:n] == doc[size - 1 :]) & enough)
    value = np.full(n, np.uint64(size))
    for k in range(size):
        value += token[k : k + n] * textops._COEFFICIENTS[k]
    return textops.mix(value)[at], at


SCHEMA = "id long, hash long, pos int, slots array<long>"
ARROW = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("pos", pa.int32()), ("slots", pa.list_(pa.int64()))])


def _batch(ids: list, hashes: np.ndarray, pos: np.ndarray, slots: np.ndarray) -> pa.RecordBatch:
    """slots: (windows, size); offsets let windows share one flat array."""
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(hashes) + 1) * slots.shape[1], pa.int32()), pa.array(slots.ravel().view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes.view(np.int64)), pa.array(pos, pa.int32()), flat], schema=ARROW)


def template_windows(texts: DataFrame, sizes: list[int], bitmap: np.ndarray | None = None) -> DataFrame:
    """(id, hash, pos, slots) of the windows of each text (columns id, text); with no bitmap, of benchmark items: one short window for a short item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, w in textops.chunks(batch.column(1), textops.IDENTITY):
                ids = np.array(batch.column(0)[rows].to_pylist(), object)
                token, slot, doc = canonical(w)
                first = np.searchsorted(doc, np.arange(len(ids) + 1))
                length = np.diff(first)
                for size in sizes:
                    hashes, at = _windows(token, slot, doc, size)
                    if bitmap is not None:
                        keep = bitmap[(hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64)]
                    else:
                        keep = np.minimum(length, WINDOW)[doc[at]] == size
                    keep &= np.array([i is not None for i in ids], bool)[doc[at]] if len(at) else keep
                    hashes, at = hashes[keep], at[keep]
                    if len(at):
                        yield _batch(ids[doc[at]].tolist(), hashes, at - first[doc[at]], slot[at[:, None] + np.arange(size)])

    return texts.select(F.col("id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), SCHEMA)


def consistent(windows: list[dict[int, int]]) -> list[int]:
    """Places of the largest set of windows (item value to document value) in which each item value has one document value."""
    left = MAX_SEARCH

    def search(some: list[int], most: int) -> list[int] | None:
        """The largest set within `some`, or None if none of more than `most` is found."""
        nonlocal left
        left -= 1
        uses: dict[int, Counter] = defaultdict(Counter)
        for k in some:
            for i, d in windows[k].items():
                uses[i][d] += 1
        open_values = {i: sum(c.values()) for i, c in uses.items() if len(c) > 1}
        if not open_values:
            return some if len(some) > most else None
        bound, shares = 0, defaultdict(Counter)  # each window counts for one of its open values, of which one document value can stay
        for k in some:
            mine = [i for i in windows[k] if i in open_values]
            if mine:
                i = max(mine, key=lambda i: (open_values[i], i))
                shares[i][windows[k][i]] += 1
            else:
                bound += 1
        if bound + sum(max(c.values()) for c in shares.values()) <= most:
            return None
        value, best = max(open_values, key=lambda i: (open_values[i], i)), None
        for d, _ in sorted(uses[value].items(), key=lambda x: (-x[1], x[0])):
            if best is not None and left <= 0:
                break
            found = search([k for k in some if windows[k].get(value, d) == d], most)
            if found is not None:
                best, most = found, len(found)
        return best

    return search(list(range(len(windows))), -1) or []


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each diagonal that count: their places in the item, and whether a value differs in one."""
    for batch in batches:
        covered, altered = [], []
        for windows in batch.column("windows").to_pylist():
            places = {w["item_pos"] for w in windows if w["pairs"] is None}
            others, maps = [], []
            for w in sorted((w for w in windows if w["pairs"] is not None), key=lambda w: (w["item_pos"], str(w["pairs"]))):
                pairs = {(p["i"], p["d"]) for p in w["pairs"]}
                if len(pairs) == len({i for i, _ in pairs}):
                    others.append(w["item_pos"])
                    maps.append(dict(pairs))
            kept = {others[k] for k in consistent(maps)}
            covered.append(sorted(places | kept))
            altered.append(bool(kept))
        columns = [batch.column(k) for k in ("doc_id", "item_id", "item_windows")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(covered, pa.list_(pa.int32())), pa.array(altered, pa.bool_())], ["doc_id", "item_id", "item_windows", "covered", "altered"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, coverage, reparameterised): one row for each leaked item of each document."""
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), "text")
    item_windows = materialise(template_windows(items, list(range(MIN_TOKENS, WINDOW + 1))), "item-windows")
    buckets = item_windows.select(F.expr(f"shiftrightunsigned(hash, {64 - MAP_BITS})").cast("int").alias("b")).distinct().collect()  # at most 2^MAP_BITS
    bitmap = np.zeros(1 << MAP_BITS, bool)
    bitmap[[r.b for r in buckets]] = True
    sizes = [r.n for r in item_windows.select(F.size("slots").alias("n")).distinct().orderBy("n").collect()]
    windows = template_windows(docs.select(F.col("doc_id").alias("id"), "text"), sizes, bitmap)
    total = item_windows.groupBy("id").agg(F.count("*").alias("item_windows"))
    right = item_windows.join(total, "id").select("hash", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "item_windows")
    if item_windows.count() <= MAX_BROADCAST:
        right = F.broadcast(right)
    pairs = F.filter(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")), lambda p: p["i"] != 0)
    matched = windows.join(right, "hash").where(F.size("slots") == F.size("item_slots"))
    window = F.struct("item_pos", F.when(F.col("slots") != F.col("item_slots"), pairs).alias("pairs"))
    diagonals = (
        matched.groupBy(F.col("id").alias("doc_id"), "item_id", "item_windows", (F.col("pos") - F.col("item_pos")).alias("diagonal"))
        .agg(F.collect_set(window).alias("windows"))
        .select("doc_id", "item_id", "item_windows", "windows")
        .mapInArrow(tidy(_counted), "doc_id long, item_id long, item_windows long, covered array<int>, altered boolean")
    )
    return (
        diagonals.groupBy("doc_id", "item_id", "item_windows")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_set("covered")))).cast("long").alias("n_windows"),
            F.bool_or("altered").alias("reparameterised"),
        )
        .select("doc_id", "item_id", "n_windows", "item_windows", (F.col("n_windows") / F.col("item_windows")).alias("coverage"), "reparameterised")
        .where(F.col("coverage") >= MIN_COVERAGE)
    )


def drop_leaked(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    """The rows of docs without a leak, with all their columns. The leaked ids are broadcast when few, else the join shuffles."""
    leaked = materialise(leaks(docs, benchmark).select(F.col("doc_id").alias("leaked_id")).distinct(), "leaked")
    right = F.broadcast(leaked) if leaked.count() <= max_broadcast else leaked
    return docs.join(right, docs["doc_id"].cast("long") == right["leaked_id"], "left_anti")
