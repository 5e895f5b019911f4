"""Vectorised tokenisation of Arrow string columns with numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A UTF-8 byte of a multi-byte character is never one of those
separators, so words can be cut and hashed on bytes, for many texts at once and without a Python object for each word.
Chunks of texts are bounded in bytes (one text longer than the bound makes a chunk alone), so memory does not grow with
the number of rows in an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IDENTITY = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that it adds no collisions."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 4096)
        up, down = _powers(_BASE, size), _powers(_INVERSE, size)
        if n > 2 * CHUNK_BYTES:  # tables for one very long text are not kept
            return up, down
        _tables["up"], _tables["down"] = up, down
    return _tables["up"], _tables["down"]


@dataclass
class Words:
    """Words of the texts of one chunk, in order. doc[i] is the row of word i within the chunk."""

    data: np.ndarray  # bytes of the chunk, mapped
    text_start: np.ndarray  # byte offsets of each text in data, one more than there are texts
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # index of the first word of each text, one more than there are texts

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial over its bytes and its length, finalised."""
        up, down = _power_tables(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=total[1:])
        value = (total[self.end] - total[self.start]) * down[self.start]
        return mix(value + (self.end - self.start).astype(np.uint64) * _MIX2)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is as empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, mapping: np.ndarray = LOWER, limit: int = CHUNK_BYTES) -> Iterator[tuple[slice, Words]]:
    """Rows of the column in bounded chunks, with their words."""
    data, offsets = string_buffers(column)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield slice(row, stop), words(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], mapping)
        row = stop


def words(data: np.ndarray, offsets: np.ndarray, mapping: np.ndarray = LOWER) -> Words:
    data = mapping[data]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] = inside[cuts]  # a text's first word does not go on from the text before it
    start = np.flatnonzero(begins)
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:] | begins[1:]
    end = np.flatnonzero(ends)
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(data, offsets, start, end, doc, np.searchsorted(start, offsets, "left"))


_COEFFICIENTS = mix(np.arange(1, 65, dtype=np.uint64) * _BASE) | np.uint64(1)


def windows(w: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of `size` words that lies within one text, and the index of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[:n] == w.doc[size - 1 :])
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value += hashes[k : k + n] * _COEFFICIENTS[k]
    return mix(value)[at], at


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a word sequence shorter than a window; its length takes part."""
    return mix(np.array([(hashes * _COEFFICIENTS[: len(hashes)]).sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64))[0]


def crc32_mod(ids, mod: int) -> np.ndarray:
    """crc32 of each id as decimal text, modulo mod; a null id counts as the empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % mod for i in ids], np.int64)
