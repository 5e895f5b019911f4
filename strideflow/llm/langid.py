"""Language identification with unigram piece models whose segmentations are summed.

The pieces are the byte strings of a fixed public vocabulary. Each language has a probability for each piece, learned by
expectation maximisation; a forward algorithm sums over all segmentations of a word into pieces, so no single segmentation
is picked. A text's log probability is the sum over its words (runs of letters and of other bytes above 127, lower-cased),
and every word of the whole text counts. Each distinct word is scored once per worker, in blocks of words of one length.

The models are fitted on a bounded sample of labelled texts: about `SAMPLE_PER_LANG` per language, drawn by a hash of doc_id
at a rate of sample / count, of which at most `MAX_SAMPLE_WORDS` distinct words per language are used. At most
`MAX_LANGS` languages are learned (the commonest, ties by name).

Null text and texts without a letter give `und` and score 0. The score is the posterior of the predicted language, with
the log probabilities divided by the square root of the number of words. With nothing to learn from, all texts are `und`.
Equal languages are decided by name. Only doc_id, text and lang are read; repeated rows each get their own result.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideflow.llm.bpe import bounded_slices
from strideflow.llm.storage import tidy

FOLDS, HELD_OUT = 4, 2
SAMPLE_PER_LANG = 600
MAX_SAMPLE_WORDS = 20_000
MAX_LANGS = 256
MAX_PIECE = 8  # bytes: a piece is packed in one 64-bit key
ROUNDS = 4
SMOOTHING = 0.05
MAX_WORDS = 200_000  # distinct words whose scores a worker keeps
BLOCK = 20_000
LONGEST = 40  # bytes of a word that goes through the blocks; a longer one goes through the scalar loop
MIN_SCORE = 0.5

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII that is no letter parts words.
_TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def split_words(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_TO_SPACE).split() if text else []


def read_pieces(path: str) -> list[bytes]:
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines]


def pack(piece: bytes) -> int:
    return int.from_bytes(piece, "little")


class PieceModel:
    """log probabilities of pieces, (pieces, languages), found by their bytes. Single bytes are always pieces."""

    def __init__(self, pieces: list[bytes], langs: list[str]):
        self.langs = langs
        self.pieces = sorted(set(pieces) | {bytes([b]) for b in range(256)}, key=lambda p: (len(p), pack(p)))
        self.longest = max(map(len, self.pieces))
        lengths = np.array([len(p) for p in self.pieces])
        self.begin = np.searchsorted(lengths, np.arange(1, self.longest + 2))
        self.keys = [np.array([pack(p) for p in self.pieces if len(p) == n], np.uint64) for n in range(1, self.longest + 1)]
        self.index = {p: i for i, p in enumerate(self.pieces)}
        self.prob = np.full((len(self.pieces) + 1, len(langs)), 1.0 / len(self.pieces))
        self.prob[-1] = 0.0  # what no substring is

    def find(self, words: np.ndarray) -> list[np.ndarray]:
        """For words of one length (rows of bytes): for each piece length, the piece at each start, or the last row."""
        count, length = words.shape
        out, key = [], np.zeros((count, length), np.uint64)
        for n in range(1, min(self.longest, length) + 1):
            key = key[:, : length - n + 1] | (words[:, n - 1 :].astype(np.uint64) << np.uint64(8 * (n - 1)))
            keys = self.keys[n - 1]
            if not len(keys):
                out.append(np.full(key.shape, len(self.pieces), np.int32))
                continue
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            out.append(np.where(keys[at] == key, at + self.begin[n - 1], len(self.pieces)).astype(np.int32))
        return out

    def forward(self, words: np.ndarray, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward sums (position, word, language) and the log of each word's probability."""
        count, length = words.shape
        alpha = np.zeros((length + 1, count, len(self.langs)))
        alpha[0] = 1.0
        for end in range(1, length + 1):
            for n in range(1, min(len(found), end) + 1):
                at = found[n - 1][:, end - n]
                some = np.flatnonzero(at < len(self.pieces)) if n > 1 else slice(None)
                alpha[end, some] += alpha[end - n, some] * self.prob[at[some]]
        return alpha, np.log(np.maximum(alpha[length], 1e-300))

    def log_probability(self, word: bytes) -> np.ndarray:
        """The same for one word of any length, in logarithms."""
        log_prob = np.log(np.maximum(self.prob, 1e-300))
        sums = np.full((len(word) + 1, len(self.langs)), -np.inf)
        sums[0] = 0.0
        for end in range(1, len(word) + 1):
            known = [(n, p) for n in range(1, min(self.longest, end) + 1) if (p := self.index.get(word[end - n : end])) is not None]
            sums[end] = np.logaddexp.reduce([sums[end - n] + log_prob[p] for n, p in known])
        return sums[-1]

    def score(self, words: list[bytes]) -> np.ndarray:
        """log probability of each word in each language."""
        out = np.zeros((len(words), len(self.langs)))
        lengths = np.array([len(w) for w in words], np.int64)
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            if length > LONGEST:
                for r in rows:
                    out[r] = self.log_probability(words[r])
                continue
            for at in range(0, len(rows), BLOCK):
                part = rows[at : at + BLOCK]
                block = np.frombuffer(b"".join([words[r] for r in part]), np.uint8).reshape(len(part), length)
                out[part] = self.forward(block, self.find(block))[1]
        return out


def expected_counts(model: PieceModel, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations, for a model of one language."""
    out = np.zeros(len(model.pieces) + 1)
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        for at in range(0, len(rows), BLOCK):
            part = rows[at : at + BLOCK]
            block = np.frombuffer(b"".join([words[r] for r in part]), np.uint8).reshape(len(part), length)
            found = model.find(block)
            alpha, _ = model.forward(block, found)
            beta = np.zeros((length + 1, len(part)))
            beta[length] = 1.0
            weight = counts[part] / np.maximum(alpha[length, :, 0], 1e-300)
            for start in range(length - 1, -1, -1):
                for n in range(1, min(len(found), length - start) + 1):
                    piece = found[n - 1][:, start]
                    step = model.prob[piece, 0] * beta[start + n]
                    beta[start] += step
                    out += np.bincount(piece, alpha[start, :, 0] * step * weight, len(out))
    return out[:-1]


def learn(samples: dict[str, dict[bytes, int]], vocabulary: list[bytes]) -> PieceModel:
    """Piece probabilities of each language from its words. Words beyond LONGEST bytes are left out of the fitting."""
    candidates = {p.lstrip(b" ") for p in vocabulary}
    usable = {p for p in candidates if 0 < len(p) <= MAX_PIECE and p.translate(_TO_SPACE) == p}
    seen = {w[i : i + n] for words in samples.values() for w in words for n in range(1, MAX_PIECE + 1) for i in range(len(w) - n + 1)}
    langs = sorted(samples)
    model = PieceModel(sorted(usable & seen), langs)
    prob = np.zeros_like(model.prob)
    for k, lang in enumerate(langs):
        words = [w for w in samples[lang] if len(w) <= LONGEST]
        counts = np.array([samples[lang][w] for w in words], float)
        one = PieceModel(model.pieces, [lang])
        for _ in range(ROUNDS):
            expected = expected_counts(one, words, counts) + SMOOTHING
            one.prob[:-1, 0] = expected / expected.sum()
        prob[:, k] = one.prob[:, 0]
    model.prob = prob
    return model


class Scorer:
    """Scores of distinct words, kept while they are few enough."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.row: dict[bytes, int] = {}
        self.rows = np.zeros((0, len(model.langs)))

    def totals(self, split: list[list[bytes]]) -> np.ndarray:
        distinct = set().union(*split)
        new = [w for w in distinct if w not in self.row]
        if len(self.row) + len(new) > MAX_WORDS:
            self.row, self.rows, new = {}, self.rows[:0], list(distinct)
        self.row.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, self.model.score(new)]) if new else self.rows
        get = self.row.__getitem__
        return np.array([self.rows[list(map(get, words))].sum(0) if words else np.zeros(len(self.model.langs)) for words in split]).reshape(len(split), -1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        split = [split_words(t) for t in texts]
        if not self.model.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        logits = self.totals(split) / np.sqrt(np.maximum([len(w) for w in split], 1))[:, None]
        posterior = np.exp(logits - logits.max(1, keepdims=True))
        posterior /= posterior.sum(1, keepdims=True)
        best = posterior.argmax(1)
        letters = np.array([bool(t and _LETTER.search(t)) for t in texts])
        names = [self.model.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
        return names, np.where(letters, posterior.max(1), 0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % FOLDS == HELD_OUT


def fit(docs: DataFrame, path: str | None = None) -> PieceModel:
    """A model learned from rows with a language outside the held-out fold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    samples: dict[str, dict[bytes, int]] = {lang: Counter() for lang in counts}
    if counts:
        rates = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, SAMPLE_PER_LANG / n)])
        draw = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 30)) / float(1 << 30)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found: Counter = Counter()
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found.update((lang, w) for w in split_words(text))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

        limit = max(1000, min(MAX_SAMPLE_WORDS, 20 * MAX_SAMPLE_WORDS // len(counts)))
        drawn = rows.where(draw < F.try_element_at(rates, F.col("lang"))).select("lang", "text")
        words = drawn.mapInArrow(tidy(count), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
        for r in words.withColumn("rank", rank).where(F.col("rank") <= limit).collect():
            samples[r.lang][bytes(r.word)] = r.n
    return learn(samples, read_pieces(path or default_vocabulary()))


def identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row."""
    model = fit(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for at, texts in bounded_slices(batch.column(1)):
                names, score = scorer.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(names), pa.array(score)], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, path: str | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs whose language is identified with at least min_score, with all their columns."""
    model = fit(docs, path)
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for at, texts in bounded_slices(batch.column(column)):
                names, score = scorer.predict(texts)
                kept = [n != "und" and s >= min_score for n, s in zip(names, score, strict=True)]
                yield batch.slice(at, len(texts)).filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
