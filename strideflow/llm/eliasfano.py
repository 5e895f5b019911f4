"""Token-id output with Elias-Fano document boundaries.

The file format is a Parquet table of blocks in the shared folder; a block is one row and holds a run of consecutive
documents in ascending doc_id order:

    part, block   place of the block: part is the number of the doc_id range, block counts within it
    n_docs        documents in the block
    n_ids         ids in the block, and first_id, the ids before it within its part
    doc_ids       Elias-Fano code of doc_id - base_doc_id (n_null rows of null doc_id come first and are not coded)
    ends          Elias-Fano code of the end offset of each document within the block
    ids           the ids one after another, little-endian, 2 bytes each where the vocabulary fits and 4 bytes otherwise

An Elias-Fano code of n non-decreasing values up to u keeps the low log2(u / n) bits of each value as they are and the high
parts as n ones in a bit string of at most 3n bits: about 2 + log2(u / n) bits a value. Every `SAMPLE`-th one has its
position in a 32-bit table, so select(i) jumps to a sample and counts on from there.

Documents are dealt to ranges of doc_id, so a hot source or hot text does not matter; equal doc_id are ordered by text. A part's
totals, one row for each range, are all that the driver gathers. Null and empty texts have only the end id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.llm import bpe
from strideflow.llm.storage import shared_dir, shuffle_partitions, tidy

END_ID = 0
BLOCK_IDS = 1 << 20
SAMPLE = 256
SCHEMA = "part int, block int, n_docs int, n_null int, n_ids long, first_id long, base_doc_id long, id_bytes int, doc_ids binary, ends binary, ids binary"


def ef_encode(values: np.ndarray) -> bytes:
    """Header (n, low bits, bytes of the high part, as 64-bit), low bits, high bits, select samples (32-bit)."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    width = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
    low = values & np.uint64((1 << width) - 1)
    bits = ((low[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel() if width else np.zeros(0, np.uint8)
    ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    packed = np.packbits(high, bitorder="little")
    return np.array([n, width, len(packed)], "<u8").tobytes() + np.packbits(bits, bitorder="little").tobytes() + packed.tobytes() + ones[::SAMPLE].astype("<u4").tobytes()


class EliasFano:
    """Random access (select) and whole decoding of a code."""

    def __init__(self, code: bytes):
        self.n, self.width, high = (int(x) for x in np.frombuffer(code, "<u8", 3))
        at = 24 + (self.n * self.width + 7) // 8
        self.low = np.frombuffer(code, np.uint8, at - 24, 24)
        self.high = np.frombuffer(code, np.uint8, high, at)
        self.samples = np.frombuffer(code, "<u4", (self.n + SAMPLE - 1) // SAMPLE, at + high)

    def _low(self, i: int) -> int:
        first = i * self.width
        span = int.from_bytes(self.low[first // 8 : (first + self.width + 7) // 8].tobytes(), "little")
        return (span >> (first % 8)) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """Value i: from the sample before it, count ones byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        position, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = position // 8
        mask = 0xFF << (position % 8) & 0xFF
        while True:
            word = int(self.high[byte]) & mask
            if left < word.bit_count():
                break
            left, byte, mask = left - word.bit_count(), byte + 1, 0xFF
        for _ in range(left):
            word &= word - 1
        position = 8 * byte + (word & -word).bit_length() - 1
        return ((position - i) << self.width) | self._low(i)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width)
            out |= (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out.astype(np.int64)


def _block(part: int, number: int, first_id: int, doc_ids: list, ids: list[bytes], id_bytes: int) -> dict:
    ends = np.cumsum([len(x) // id_bytes for x in ids])
    known = np.array([i for i in doc_ids if i is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    return {
        "part": part, "block": number, "n_docs": len(ids), "n_null": len(ids) - len(known), "n_ids": int(ends[-1]), "first_id": first_id, "base_doc_id": base, "id_bytes": id_bytes,
        "doc_ids": ef_encode(known.astype(np.uint64) - np.uint64(base % (1 << 64))), "ends": ef_encode(ends), "ids": b"".join(ids),
    }


def write_ids(docs: DataFrame, path: str | None = None, vocabulary: str | None = None) -> str:
    """Encodes every text, appends END_ID and writes the blocks; returns where."""
    spark = docs.sparkSession
    vocabulary = vocabulary or bpe.default_vocabulary()
    path = path or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = bpe.word_table(vocabulary)
        id_bytes = 2 if table.tokenizer.get_vocab_size() <= 1 << 16 else 4
        kind = np.dtype(f"<u{id_bytes}")
        end = np.array([END_ID], kind).tobytes()
        part, number, first_id = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, first_id, doc_ids, held, size
            row = _block(part, number, first_id, doc_ids, held, id_bytes)
            number, first_id, doc_ids, held, size = number + 1, first_id + size, [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            for at, texts in bpe.bounded_slices(batch.column(1), 4 * bpe.BATCH_CHARS):
                for doc_id, ids in zip(batch.column(0).slice(at, len(texts)).to_pylist(), table.encode(texts), strict=True):
                    ids = np.frombuffer(ids, "<u4").astype(kind).tobytes() + end
                    if held and size + len(ids) // id_bytes > BLOCK_IDS:
                        yield flush()
                    doc_ids.append(doc_id)
                    held.append(ids)
                    size += len(ids) // id_bytes
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ranges.mapInArrow(tidy(run), SCHEMA).write.option("compression", "none").parquet(path)
    return path


ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int32()), ("n_null", pa.int32()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("base_doc_id", pa.int64()), ("id_bytes", pa.int32()), ("doc_ids", pa.binary()), ("ends", pa.binary()), ("ids", pa.binary())])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of each document in the files: start counts the ids of all documents before it."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    totals = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one row for each range
    before, base = 0, {}
    for part in sorted(totals):
        base[part] = before
        before += totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (row for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
                offsets = EliasFano(b["ends"])
                ends = np.fromiter(map(offsets.select, range(offsets.n)), np.int64, offsets.n)
                starts = np.concatenate([[0], ends[:-1]])
                doc_ids = [None] * b["n_null"] + (EliasFano(b["doc_ids"]).values() + b["base_doc_id"]).tolist()
                ids = np.frombuffer(b["ids"], f"<u{b['id_bytes']}").astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + base[b["part"]] + b["first_id"], pa.int64()), pa.array([ids[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary())],
                    ["doc_id", "start", "ids"],
                )

    return blocks.mapInArrow(tidy(run), "doc_id long, start long, ids binary")


def write_read_digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row, read back from the files."""
    stored = read_ids(docs.sparkSession, write_ids(docs, vocabulary=vocabulary))
    return stored.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
