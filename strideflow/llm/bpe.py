"""BPE encoding and decoding by a distinct-word table.

1. Split: every text is cut in words on the executors. A chunk (texts of about `CHUNK_CHARS` characters of one task) numbers its distinct words;
   the chunk's dictionary is dealt to buckets by a hash of the word, and its texts are the lists of their words' numbers. Both are written once, packed, to the shared folder.
2. The dictionaries of all chunks meet by bucket, which gives the distinct-word table: each of its words is encoded once. A word stands once in
   a chunk, so no word is hot, and there are as many buckets as shuffle partitions, so a bucket is a task's share.
3. Ids are joined back by position: the ids of a chunk's words (packed by chunk) and the chunk's texts meet in one task, in order, and each number is
   replaced by its word's ids. A chunk is bounded (a longer text is a chunk alone), so no group grows with the input.
4. Decoding joins ids with the id-to-piece table. It has one row for each id from 0 on, as many as the vocabulary, so the join is a
   lookup in a broadcast array.

A word is what lies between two cuts; a cut is before a space. The tokenizer's own pre-tokenisation never joins characters across such
a cut, unless a space stands inside a longer run of white space: texts with such a run are cut only where one space parts two characters
that are no white space. The string of a special token is a word by itself.

Distinct words are encoded many at a time, joined by their spaces. Where the vocabulary file is a byte-level BPE whose ids are in
the order of its merges, the merging runs in tiktoken, which reads that file's vocabulary as ranks and gives the same ids several
times faster; any other file, and words that are long or hold further white space, go through the tokenizers library word by word.
`WordTable.encode` encodes a few texts at once in one process, for callers that want no shuffle.

Null and empty texts have no ids and decode to the empty text. Repeated rows, null doc_id and further columns of any name
are allowed: there is one output row per input row, and only doc_id and text are read. Very long texts and words are handled whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.llm import textops
from strideflow.llm.storage import materialise, shuffle_partitions, tidy

BATCH_CHARS = 2_000_000
JOINED_WORDS = 20_000
LONG_WORD = 1000
CHUNK_CHARS = 32_000_000
SLICE_CHARS = 2_000_000
#: White space, a space inside the run or before the end of the text: there the cut before the space could part what is one token.
_INSIDE_RUN = re.compile(r"\s (?:\s|\Z)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_CUT = re.compile(r"(?<=\S)(?= \S)")


def cut(text: str, special: re.Pattern | None) -> list[str]:
    """Words of a text, which give the text again when joined; each is encoded by itself."""
    if special is not None and special.search(text):
        parts = special.split(text)  # every second one is a special token
        return [w for k, part in enumerate(parts) if part for w in ([part] if k % 2 else cut(part, None))]
    if "\0" in text or _INSIDE_RUN.search(text):
        return _CUT.split(text)
    return [w for w in text.replace(" ", "\0 ").split("\0") if w]


class Index(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _ranks(path: str):
    """The vocabulary as ranks, if its ids are in the order of its merges and its texts are cut as byte-level BPE does; else None."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    cut, model = parts["pre_tokenizer"] or {}, parts["model"]
    if model["type"] != "BPE" or parts["normalizer"] or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space"):
        return None
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if model.get("ignore_merges") or merged != list(range(256, 256 + len(merged))):
        return None
    plain = {p: i for i, p in enumerate(pieces(path)) if i < 256 + len(merged)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=plain, special_tokens={})


def special_pattern(special: list[str]) -> re.Pattern | None:
    return re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None


class WordTable:
    """Ids of each distinct word, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special_pattern = special_pattern(self.special)
        self.ranks = _ranks(path)
        self.leads = np.array([p[:1] == b" " for p in pieces(path)])  # ids that begin with a space begin a word

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def find_words(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, length, ids): the ids of " " + word stand at ids[first : first + length], for each word."""
        first, length, held, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), [], 0
        some = [k for k, w in enumerate(distinct) if w and len(w) < LONG_WORD and w == w.strip() and " " not in w] if self.ranks else []
        for at in range(0, len(some), JOINED_WORDS):
            part = some[at : at + JOINED_WORDS]
            ids = np.asarray(self.ranks.encode_to_numpy(" " + " ".join([distinct[k] for k in part]), disallowed_special=())).astype("<u4")
            starts = np.flatnonzero(self.leads[ids])
            if len(starts) == len(part):
                first[part], length[part] = starts + size, np.diff(starts, append=len(ids))
                held.append(ids)
                size += len(ids)
        rest = np.flatnonzero(length == 0).tolist()  # no word is without ids
        found = self._encode([" " + distinct[k] for k in rest])
        length[rest] = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first[rest] = size + np.cumsum(length[rest]) - length[rest]
        return first, length, np.concatenate([*held, np.frombuffer(b"".join(found), "<u4")])

    def encode_words(self, distinct: list[str]) -> dict[str, bytes]:
        """Ids of " " + word for each word."""
        first, length, ids = self.find_words(distinct)
        body = ids.tobytes()
        return {w: body[s:e] for w, s, e in zip(distinct, (first * 4).tolist(), ((first + length) * 4).tolist(), strict=True)}

    def encode_pieces(self, distinct: list[str]) -> list[bytes]:
        """Ids of each word of cut()."""
        plain = self.encode_words([w[1:] for w in distinct if w[:1] == " "])
        others = [w for w in distinct if w[:1] != " "]
        found = dict(zip(others, self._encode(others), strict=True))
        return [plain[w[1:]] if w[:1] == " " else found[w] for w in distinct]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text. Its words are numbered by Arrow, each distinct one of all the texts is encoded once, and ids are gathered by number."""
        out: list[bytes] = [b""] * len(texts)
        plain: list[int] = []
        for i, text in enumerate(texts):
            if text and (_INSIDE_RUN.search(text) or any(s in text for s in self.special)):
                out[i] = b"".join(self.encode_pieces(cut(text, self.special_pattern)))
            elif text:
                plain.append(i)
        if not plain:
            return out
        words = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        bounds, flat = words.offsets.to_numpy().astype(np.int64), words.flatten()
        opening = self._encode(flat.take(pa.array(bounds[:-1])).to_pylist())  # the first word of a text has no space before it
        coded = flat.dictionary_encode()
        first, length, ids = self.find_words(coded.dictionary.to_pylist())
        number, own = coded.indices.to_numpy().astype(np.int64), np.fromiter(map(len, opening), np.int64, len(opening)) // 4
        number[bounds[:-1]] = len(first) + np.arange(len(own))
        first, length, ids = np.concatenate([first, len(ids) + np.cumsum(own) - own]), np.concatenate([length, own]), np.concatenate([ids, np.frombuffer(b"".join(opening), "<u4")])
        size = length[number]
        stop = np.cumsum(size)
        body, end = ids[np.repeat(first[number] - stop + size, size) + np.arange(stop[-1])], stop[bounds[1:] - 1].tolist()
        for i, s, e in zip(plain, [0, *end[:-1]], end, strict=True):
            out[i] = body[s:e].tobytes()
        return out


_worker: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """One table per worker process; tasks that follow use it on."""
    if path not in _worker:
        _worker[path] = WordTable(path)
    return _worker[path]


def pieces(path: str) -> list[bytes]:
    """Bytes of each id: the inverse of the byte-level alphabet, in which printable Latin-1 characters stand for themselves."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    out = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for piece, i in tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    return out


def bounded_slices(column: pa.Array, chars: int = BATCH_CHARS) -> Iterator[tuple[int, list]]:
    """Values of a column in slices of bounded length; one value longer than the bound makes a slice alone."""
    at, rows, size = 0, [], 0
    for value in column:
        value = value.as_py()
        if rows and size + len(value or "") > chars:
            yield at, rows
            at, rows, size = at + len(rows), [], 0
        rows.append(value)
        size += len(value or "")
    if rows:
        yield at, rows


SPLIT = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("at", pa.int64()), ("body", pa.binary())])
WORDS, TEXTS = 0, 1
_RAW = "<u4"
_LEVEL = 6
_NEAR = 128  # codes below it take one byte


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", _LEVEL).compress(raw, asbytes=True)


def expand(body: bytes) -> bytes:
    return pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True)


def framed(*parts: bytes) -> bytes:
    """Strings in one, each after its length."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unframed(body: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(body):
        size = int.from_bytes(body[at : at + 8], "little")
        out.append(body[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def pack(parts: list[np.ndarray]) -> bytes:
    """Integer arrays in one compressed string: their number, their lengths, then their values in planes of one byte each."""
    flat = np.concatenate(parts) if parts else np.zeros(0)
    head = np.array([len(parts), *map(len, parts)], _RAW)
    planes = np.ascontiguousarray(np.concatenate([head, flat.astype(_RAW)]).view(np.uint8).reshape(-1, 4).T)
    return len(head).to_bytes(4, "little") + squeeze(planes.tobytes())


def unpack(body: bytes) -> list[np.ndarray]:
    n = int.from_bytes(body[:4], "little")
    planes = np.frombuffer(expand(body[4:]), np.uint8).reshape(4, -1)
    values = np.ascontiguousarray(planes.T).view(_RAW).ravel()
    return np.split(values[n:], np.cumsum(values[1:n])[:-1]) if n > 1 else []


def code_new(numbers: np.ndarray, before: int) -> np.ndarray:
    """Numbers given in the order of first use, of which `before` were given earlier: 0 for the next new one, else the number + 1, so that rare words cost little."""
    highest = np.maximum.accumulate(np.concatenate([[before - 1], numbers.astype(np.int64)]))
    return np.where(numbers > highest[:-1], 0, numbers.astype(np.int64) + 1)


def number_new(codes: np.ndarray, before: int) -> np.ndarray:
    """The inverse of code_new."""
    new = codes == 0
    return np.where(new, before + np.cumsum(new) - 1, codes.astype(np.int64) - 1)


def buckets_of(words: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each word, the same in every process."""
    out = []
    for at in range(0, len(words), JOINED_WORDS):
        data, offsets = textops.string_buffers(words.slice(at, JOINED_WORDS))
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        out.append(textops.Words(data, offsets, offsets[:-1], offsets[1:], np.arange(len(offsets) - 1), np.arange(len(offsets))).hashes() % np.uint64(buckets))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def pack_codes(codes: np.ndarray) -> bytes:
    """Codes in one compressed string. A small code is one byte; a greater one has a byte of its own range, so that its two bytes share what they tell, and a lower byte apart."""
    far = codes >= _NEAR
    high, head = (codes[far] - _NEAR) >> 8, codes.copy()
    head[far] = _NEAR + np.minimum(high, 255 - _NEAR)
    tail = (codes[far] - _NEAR) & 255
    return framed(squeeze(head.astype(np.uint8).tobytes()), squeeze(tail.astype(np.uint8).tobytes()), pack([high[high >= 255 - _NEAR]]))


def unpack_codes(body: bytes) -> np.ndarray:
    head, tail, beyond = unframed(body)
    codes = np.frombuffer(expand(head), np.uint8).astype(np.int64)
    far = codes >= _NEAR
    high = codes[far] - _NEAR
    high[high == 255 - _NEAR] = unpack(beyond)[0]
    codes[far] = _NEAR + (high << 8) + np.frombuffer(expand(tail), np.uint8)
    return codes


def pack_ids(ids: list[bytes]) -> bytes:
    """The ids of many words in one compressed string, two bytes to an id where all fit."""
    flat = np.frombuffer(b"".join(ids), _RAW)
    width = 2 if not len(flat) or flat.max() < 1 << 16 else 4
    return framed(pack([np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.array([width])]), squeeze(flat.astype(f"<u{width}").tobytes()))


def unpack_ids(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The number of ids of each word, and all ids."""
    head, flat = unframed(body)
    lengths, width = unpack(head)
    return lengths.astype(np.int64), np.frombuffer(expand(flat), f"<u{width[0]}").astype(_RAW)


def pack_words(words: pa.Array) -> bytes:
    data, offsets = textops.string_buffers(words)
    return framed(pack([np.diff(offsets)]), squeeze(data[offsets[0] : offsets[-1]].tobytes()))


def unpack_words(body: bytes) -> list[str]:
    head, text = unframed(body)
    lengths = unpack(head)[0].astype(np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int64())
    return pa.LargeStringArray.from_buffers(len(lengths), offsets.buffers()[1], pa.py_buffer(expand(text))).to_pylist()


def split_texts(docs: DataFrame, special: list[str], buckets: int, chars: int = CHUNK_CHARS) -> DataFrame:
    """(chunk, kind, at, body): of kind WORDS a bucket (at) of the chunk's dictionary; of kind TEXTS a slice of its texts (their doc_id and the numbers of
    their words) and, at -1, the bucket of each number. Words of one bucket stand in the order of their numbers, so no number is written beside a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pattern = special_pattern(special)
        chunk, index, size, slices = TaskContext.get().partitionId() << 24, Index(), 0, 0

        def row(kind: int, at: int, body: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"chunk": chunk, "kind": kind, "at": at, "body": body}], schema=SPLIT)

        def dictionary() -> Iterator[pa.RecordBatch]:
            words = pa.array(list(index), pa.large_string())
            bucket = buckets_of(words, buckets)
            yield row(TEXTS, -1, pack([bucket]))
            place = np.argsort(bucket, kind="stable")
            words, bucket = words.take(pa.array(place)), bucket[place]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(bucket)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                yield row(WORDS, int(bucket[s]), pack_words(words.slice(s, e - s)))

        for batch in batches:
            for at, texts in bounded_slices(batch.column(1), min(SLICE_CHARS, chars)):
                ids = batch.column(0).slice(at, len(texts)).cast(pa.int64())
                known = np.frombuffer(np.array(ids.fill_null(0)).astype("<i8").tobytes(), _RAW)
                null = np.flatnonzero(np.array(ids.is_null())).astype(_RAW)
                before = len(index)
                numbers = [np.fromiter(map(index.__getitem__, cut(t, pattern) if t else ()), _RAW) for t in texts]
                head = pack([known, null, np.array([before]), np.array([len(x) for x in numbers])])
                yield row(TEXTS, slices, framed(head, pack_codes(code_new(np.concatenate(numbers), before))))
                size, slices = size + sum(map(len, filter(None, texts))), slices + 1
                if size >= chars:
                    yield from dictionary()
                    chunk, index, size, slices = chunk + 1, Index(), 0, 0
        if slices:
            yield from dictionary()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "chunk long, kind int, at long, body binary")


def encode_distinct(dictionaries: DataFrame, path: str) -> DataFrame:
    """(chunk, kind, at, body): every distinct word of a bucket is encoded once, and the ids of each chunk's words are packed for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last, held = word_table(path), None, []

        def send() -> Iterator[pa.RecordBatch]:
            found = list(dict.fromkeys(w for _, words in held for w in words))
            ids = dict(zip(found, table.encode_pieces(found), strict=True))
            for chunk, words in held:
                yield pa.RecordBatch.from_pylist([{"chunk": chunk, "kind": WORDS, "at": last, "body": pack_ids([ids[w] for w in words])}], schema=SPLIT)
            held.clear()

        for batch in batches:
            for r in batch.to_pylist():
                if r["at"] != last:
                    yield from send()
                    last = r["at"]
                held.append((r["chunk"], unpack_words(r["body"])))
        yield from send()

    dealt = dictionaries.repartition(shuffle_partitions(dictionaries.sparkSession), "at").sortWithinPartitions("at", "chunk")
    return dealt.mapInArrow(tidy(run), "chunk long, kind int, at long, body binary")


def by_position(split: DataFrame, path: str, finish: Callable[[list[np.ndarray]], list[pa.Array]], schema: str) -> DataFrame:
    """(doc_id, …): finish() makes columns of the ids of many texts. split: as of split_texts."""
    numbered = encode_distinct(split.where(F.col("kind") == WORDS), path)
    texts = split.where(F.col("kind") == TEXTS)
    together = numbered.unionByName(texts).repartition(shuffle_partitions(split.sparkSession), "chunk").sortWithinPartitions("chunk", "kind", "at")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lengths, values, flat, first, size = None, [], [], None, None, None
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, kind, body = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(3)[k].as_py()
                if chunk != last:
                    last, lengths, values, flat = chunk, [], [], None
                if kind == WORDS:
                    length, ids = unpack_ids(body)
                    lengths.append(length)
                    values.append(ids)
                    continue
                if batch.column(2)[k].as_py() < 0:  # ids stand by bucket and number, as the buckets' words did
                    place = np.argsort(unpack(body)[0], kind="stable")
                    if len(place):
                        length, flat = np.concatenate(lengths), np.concatenate(values)
                        first, size = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                        first[place], size[place] = np.cumsum(length) - length, length
                    lengths, values = [], []
                    continue
                head, codes = unframed(body)
                known, null, before, counts = unpack(head)
                texts = np.split(number_new(unpack_codes(codes), int(before[0])), np.cumsum(counts.astype(np.int64))[:-1])
                doc_ids = np.frombuffer(known.tobytes(), "<i8")
                mask = np.zeros(len(doc_ids), bool)
                mask[null] = True
                for low in range(0, len(texts), 256):
                    out = []
                    for at in texts[low : low + 256]:
                        if not len(at):
                            out.append(at)
                            continue
                        length = size[at]
                        stop = np.cumsum(length)
                        out.append(flat[np.repeat(first[at] - stop + length, length) + np.arange(stop[-1])])
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[low : low + 256], pa.int64(), mask=mask[low : low + 256]), *finish(out)], names)

    return together.mapInArrow(tidy(run), schema)


def _split(docs: DataFrame, path: str) -> DataFrame:
    return materialise(split_texts(docs, WordTable(path).special, shuffle_partitions(docs.sparkSession)), "split-texts")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): ids is binary, little-endian unsigned 32-bit integers in the order of the text."""
    path = path or default_vocabulary()
    return by_position(_split(docs, path), path, lambda ids: [pa.array([i.tobytes() for i in ids], pa.binary())], "doc_id long, ids binary")


class Pieces:
    """The id-to-piece table, indexed by id."""

    def __init__(self, path: str):
        found = pieces(path)
        self.flat = np.frombuffer(b"".join(found), np.uint8)
        self.length = np.array([len(p) for p in found], np.int64)
        self.first = np.cumsum(self.length) - self.length

    def text(self, ids: np.ndarray) -> str:
        """The text of ids. Bytes that are no UTF-8 become U+FFFD; an id outside the vocabulary raises."""
        length = self.length[ids]
        stop = np.cumsum(length)
        return self.flat[np.repeat(self.first[ids] - stop + length, length) + np.arange(stop[-1] if len(stop) else 0)].tobytes().decode("utf-8", "replace")


_pieces: dict[str, Pieces] = {}


def piece_table(path: str) -> Pieces:
    """One table per worker process."""
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text): the ids, and the text decoded from them."""
    path = path or default_vocabulary()
    def finish(ids: list[np.ndarray]) -> list[pa.Array]:
        return [pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(list(map(piece_table(path).text, ids)), pa.string())]

    return by_position(_split(docs, path), path, finish, "doc_id long, ids binary, text string")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text) by the id-to-piece table; bytes that are no UTF-8 become U+FFFD. An id outside the vocabulary raises."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = piece_table(path).text
        for batch in batches:
            for at, rows in bounded_slices(batch.column(1), 4 * BATCH_CHARS):
                texts = [of(np.frombuffer(ids or b"", "<u4")) for ids in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), batch.column(1).slice(at, len(rows)), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, ids binary, text string")


def encode_decode_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    return encode_decode(docs, path).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
