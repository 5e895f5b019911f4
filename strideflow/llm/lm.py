"""LM scoring with a causal self-attention model in numpy on subword ids, and a unigram base score.

Words (runs without ASCII white space, A-Z lower-cased) are numbered by Arrow in slices of many texts and encoded with a fixed public
vocabulary, each distinct word once per slice, and ids are gathered by number; a text is the ids of its words and an end id. The model has one causal self-attention head with a learned bias for each
distance, a residual feed-forward layer and an output in two levels: P(id) = P(group | context) P(member | group, context). Groups
are clusters of ids that follow similar ids. The `MEMBERS` commonest ids are members; each group has one more member for the others that
it holds, and they share its probability by the subword counts of all training texts. The score of a text is the sum over its ids.
A text is cut in blocks of `STRIDE` targets; the context window of a block is the block and the ids
before it, so windows overlap and each token is scored once; a mask hides later ids and padding.

The corpus counts (words and subwords) cover all training texts, and so does training: after a start on a bounded sample of texts
on the driver (`START_IDS`), every training text is cut in segments of `SEGMENT` words, and each segment is dealt to one of `ROUNDS` rounds by a hash of
doc_id and place: every word of every training text is learned from once. In each round every task takes the current weights, makes one pass of
Adam over its windows, `CHUNK` of them held at a time, and the weights are averaged by the number of windows, piece by piece on the executors; the driver
gets one model's worth of weights a round.

Word counts: those of the `COMMON` commonest words are broadcast; the other words of each text are joined with the count
table, a row for each distinct word of a text, so no join key is hot. That bound decides where a count is looked up, never a result.
Null text is empty: it has the end alone. Null
doc_id belongs to the training texts. Repeated rows each get their own result. Only doc_id and text are read, in slices of bounded
length; a very long text makes a slice alone.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow.llm import bpe, textops
from strideflow.llm.storage import keep_freed, materialise, tidy

FOLDS, HELD_OUT = 7, 2
COMMON = 1 << 17
MAX_WORDS = 300_000  # distinct words whose ids a table keeps
SLICE_CHARS, COUNT_CHARS = 2_000_000, 8_000_000  # bytes of text whose words are numbered at once; a longer text is alone
ROW_WINDOWS = 1 << 14  # windows in a row
START_DOCS, START_IDS = 600, 600_000
SEGMENT, ROUNDS = 64, 2
DRAW = ROUNDS  # rounds a segment may fall in; more than ROUNDS would leave segments out
CHUNK = 1 << 16  # windows that a learning task holds
LOCAL_BATCH, LOCAL_RATE = 512, 0.004
PIECES = 32  # in which weights are summed
STRIDE = 16
WINDOW = STRIDE + 8
WIDTH, HIDDEN = 16, 48
MEMBERS, GROUPS, SLOTS = 3008, 64, 48
STEPS, BATCH, RATE = 1500, 128, 0.01
PRIOR = 0.01
BLOCK = 1024  # windows scored at once
SEED = 2
LOG10 = np.log(10.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % FOLDS == HELD_OUT


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


@dataclass
class Numbered:
    """The words of some rows, as numbers in a dictionary of the distinct ones."""

    at: int  # the first of the rows
    distinct: pa.LargeStringArray
    number: np.ndarray  # of each word
    bounds: np.ndarray  # the first word of each row, one more than there are rows

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


def numbered(column: pa.Array, limit: int = SLICE_CHARS) -> Iterator[Numbered]:
    """Words of the texts of a column, numbered by Arrow in slices of bounded length."""
    column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    offsets, at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1], 0
    while at < len(column):
        stop = min(max(int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1, at + 1), len(column))
        split = pc.ascii_split_whitespace(pc.ascii_lower(column.slice(at, stop - at)))
        flat, ends = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        some = pc.not_equal(pc.binary_length(flat), 0)  # white space at an end of a text gives an empty word
        before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
        coded = flat.filter(some).dictionary_encode()
        yield Numbered(at, coded.dictionary, coded.indices.to_numpy().astype(np.int64), before[ends - ends[0]])
        at = stop


class SubwordTable:
    """Subword ids of each distinct word, kept while they are few enough."""

    def __init__(self, path: str):
        self.table = bpe.word_table(path)
        self.size = self.table.tokenizer.get_vocab_size()
        self.end = self.size  # an id of its own, which no text holds
        self.known: dict[bytes, bytes] = {}

    def add(self, distinct: set[bytes]) -> None:
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > MAX_WORDS:
            self.known, new = {}, list(distinct)
        first, length, ids = self.find([w.decode("utf-8", "replace") for w in new])
        body = ids.tobytes()
        self.known.update((w, body[4 * f : 4 * (f + n)]) for w, f, n in zip(new, first.tolist(), length.tolist(), strict=True))

    def find(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, length, ids): the ids of each word stand at ids[first : first + length]."""
        self.table.tokenizer.encode_special_tokens = True  # the string of a special token in a word is ordinary text
        try:
            return self.table.find_words(distinct)
        finally:
            self.table.tokenizer.encode_special_tokens = False

    def stream(self, found: Numbered, begin: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """For each row in turn the ids that begin a text, those of its words and the end; and the place of each word, then of each row's end."""
        first, length, ids = self.find(found.distinct.to_pylist())
        words, rows = len(found.number), found.rows
        size, start = np.empty(words + rows, np.int64), np.empty(words + rows, np.int64)  # a row's end counts as a word after its words
        end = found.bounds[1:] + np.arange(rows)
        own = np.ones(words + rows, bool)
        own[end] = False
        size[own], start[own], size[end], start[end] = length[found.number], first[found.number], 1, len(ids)
        ids = np.append(ids.astype(np.int32), np.int32(self.end))
        lead = np.repeat(np.arange(1, rows + 1) * len(begin), np.diff(np.concatenate([[0], end + 1])))
        stop = np.cumsum(size)
        place = stop - size + lead
        out = np.empty(int(stop[-1]) + rows * len(begin) if rows else 0, np.int32)
        where = np.ones(len(out), bool)
        heads = (np.concatenate([[0], place[end[:-1]] + 1])[:, None] + np.arange(len(begin))).ravel() if rows and begin else np.zeros(0, np.int64)
        where[heads] = False
        out[heads] = np.tile(np.array(begin, np.int32), rows)
        out[where] = ids[np.repeat(start - (stop - size), size) + np.arange(stop[-1] if rows else 0)]
        return out, place

    def sequence(self, text_words: list[bytes], end: bool = True) -> np.ndarray:
        """Ids of the words, and the end."""
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, text_words)), np.uint32).astype(np.int32)
        return np.append(ids, np.int32(self.end)) if end else ids


class Attention:
    """Weights, class tables, training and scoring. Ids: 0..end, then the padding id."""

    def __init__(self, counts: np.ndarray, sequences: list[np.ndarray] = (), seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.end, self.pad, self.begin = len(counts) - 1, len(counts), len(counts) + 1
        self.kind = "<u2" if self.begin < 1 << 16 else "<i4"  # in which windows are stored
        self._group(counts, sequences, rng)
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        features = HIDDEN + WIDTH
        mass = np.zeros((GROUPS, SLOTS))
        np.add.at(mass, (self.group, self.slot), counts + PRIOR)
        self.within = np.log((counts + PRIOR) / mass[self.group, self.slot])
        slots = np.where(mass > 0, np.log(np.maximum(mass, 1e-9) / np.maximum(mass.sum(1, keepdims=True), 1e-9)), -1e9)
        self.w = {
            "e": (0.3 * rng.standard_normal((len(counts) + 2, WIDTH))).astype(np.float32), "q": normal(WIDTH, WIDTH), "k": normal(WIDTH, WIDTH), "v": normal(WIDTH, WIDTH), "near": np.zeros(WINDOW, np.float32),
            "f": normal(2 * WIDTH, HIDDEN), "fb": np.zeros(HIDDEN, np.float32), "o": 0.3 * normal(features, GROUPS), "ob": np.log((mass.sum(1) + 1) / (mass + 1).sum()).astype(np.float32),
            "p": 0.3 * normal(GROUPS, features, SLOTS), "pb": slots.astype(np.float32),
        }
        distance = (np.arange(STRIDE) + WINDOW - STRIDE)[:, None] - np.arange(WINDOW)[None]
        self.distance, self.future = np.maximum(distance, 0), distance < 0
        self.prepared: tuple | None = None

    def _group(self, counts: np.ndarray, sequences: list[np.ndarray], rng: np.random.Generator) -> None:
        """group and slot of each id: k-means over which ids come before, filled in order of count up to SLOTS - 1 members; the last slot is the others'."""
        order = np.argsort(-counts, kind="stable")
        members = order[: min(MEMBERS, GROUPS * (SLOTS - 1), len(counts))]
        before = np.zeros((len(counts), 64))
        for s in sequences:
            np.add.at(before, (s[1:], (s[:-1].astype(np.int64) * 40503 >> 4) % 64), 1.0)
        x = np.sqrt(before[members])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        centre = x[np.linspace(0, min(len(x), 4 * GROUPS) - 1, GROUPS).astype(int)] + 1e-3 * rng.random((GROUPS, 64))
        for _ in range(10):
            near = (x @ centre.T).argmax(1)
            total = np.zeros_like(centre)
            np.add.at(total, near, x)
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            centre = np.where(norm > 0, total / np.maximum(norm, 1e-9), centre)
        self.group = np.zeros(len(counts), np.int32)
        self.slot = np.full(len(counts), SLOTS - 1, np.int32)
        self.group[order] = np.arange(len(counts)) % GROUPS
        used = np.zeros(GROUPS, int)
        for i, best in zip(members, np.argsort(-(x @ centre.T), axis=1), strict=True):
            g = next(g for g in best if used[g] < SLOTS - 1)
            self.group[i], self.slot[i] = g, used[g]
            used[g] += 1

    def windows(self, sequences: list[np.ndarray], before: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs (window, WINDOW), targets (window, STRIDE; pad where there is none) and the sequence of each window. before: the id before each sequence, if it begins no text."""
        blocks = np.array([-(-len(s) // STRIDE) for s in sequences], np.int64)
        lead = WINDOW - STRIDE
        first = np.concatenate([[0], np.cumsum(blocks * STRIDE + lead)])
        flat_in = np.full(first[-1] + 1, self.pad, np.int32)
        flat_out = np.full(first[-1] + 1, self.pad, np.int32)
        for s, at, start in zip(sequences, first[:-1] + lead, before or [self.begin] * len(sequences), strict=True):
            flat_in[at] = start
            flat_in[at + 1 : at + len(s)] = s[:-1]
            flat_out[at : at + len(s)] = s
        owner = np.repeat(np.arange(len(sequences)), blocks)
        start = np.arange(len(owner)) * STRIDE + owner * lead
        return flat_in[start[:, None] + np.arange(WINDOW)], flat_out[start[:, None] + lead + np.arange(STRIDE)], owner

    def forward(self, inputs: np.ndarray, tables: tuple | None = None) -> tuple:
        w = self.w
        q, k, v = tables or (w["e"] @ w["q"], w["e"] @ w["k"], w["e"] @ w["v"])
        qi, ki, vi = q[inputs[:, WINDOW - STRIDE :]], k[inputs], v[inputs]
        score = qi @ ki.transpose(0, 2, 1) / np.float32(np.sqrt(WIDTH)) + w["near"][self.distance]
        score += np.where(self.future[None] | (inputs == self.pad)[:, None, :], np.float32(-1e9), np.float32(0))
        score -= score.max(2, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(2, keepdims=True)
        x = w["e"][inputs[:, WINDOW - STRIDE :]]
        h = np.concatenate([x, score @ vi], 2).reshape(-1, 2 * WIDTH)
        u = np.maximum(h @ w["f"] + w["fb"], 0)
        g = np.concatenate([u, h[:, :WIDTH]], 1)
        return g, (qi, ki, vi, score, h, u)

    @staticmethod
    def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities and log of their sum, in place."""
        top = logits.max(1, keepdims=True)
        logits -= top
        np.exp(logits, out=logits)
        total = logits.sum(1, keepdims=True)
        logits /= total
        return logits, total

    def _distinct(self, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct ids, the place of each input among them, and the order and bounds that bring equal ids together."""
        flat = inputs.ravel().astype(self.kind)
        order = np.argsort(flat, kind="stable")
        ids = flat[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        place = np.empty(len(flat), np.int64)
        place[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(flat)))
        return ids[first], place.reshape(inputs.shape), order, first

    def step(self, inputs: np.ndarray, targets: np.ndarray) -> tuple[float, dict]:
        """Mean loss over the targets and its gradients. Logits are not shifted before exp(); a batch where one overflows is done again with shifted ones."""
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            loss, grad = self._step(inputs, targets)
        return (loss, grad) if np.isfinite(loss) else self._step(inputs, targets, True)

    def _step(self, inputs: np.ndarray, targets: np.ndarray, shift: bool = False) -> tuple[float, dict]:
        """Queries, keys and values are made once for each distinct id of the batch; from the attention on, targets are in the order of their groups."""
        w, n, lead, unit = self.w, len(inputs), WINDOW - STRIDE, self.w["e"].dtype.type(1 / np.sqrt(WIDTH))
        used, place, order, first = self._distinct(inputs)
        e, last = w["e"][used], place[:, lead:]
        qi, ki, vi = np.take(e @ (w["q"] * unit), last, 0), np.take(e @ w["k"], place, 0), np.take(e @ w["v"], place, 0)
        score = qi @ ki.transpose(0, 2, 1)
        score += np.where(self.future, w["near"].dtype.type(-1e9), w["near"][self.distance])
        begins = np.flatnonzero(inputs[:, 0] == self.pad)
        score[begins] -= np.where(inputs[begins] == self.pad, unit.dtype.type(1e9), unit.dtype.type(0))[:, None, :]
        if shift:
            score -= score.max(2, keepdims=True)
        np.exp(score, out=score)
        weight = (1 / (score.reshape(-1, WINDOW) @ np.ones(WINDOW, unit.dtype)))[:, None]  # scores are left as they are, and what is made of them is divided
        a = (score @ vi).reshape(-1, WIDTH) * weight
        flat = targets.ravel()
        rows = np.flatnonzero(flat < self.pad)
        rows = rows[np.argsort(self.group[flat[rows]].astype(np.int16), kind="stable")]
        group, slot, at, count = self.group[flat[rows]], self.slot[flat[rows]], np.arange(len(rows)), len(rows)
        bounds = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        parts = [(k, slice(low, high)) for k, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if low < high]
        h = np.empty((count, 2 * WIDTH), unit.dtype)
        h[:, :WIDTH], h[:, WIDTH:] = np.take(e, last.ravel()[rows], 0), np.take(a, rows, 0)
        u = h @ w["f"]
        u += w["fb"]
        g = np.empty((count, HIDDEN + WIDTH), unit.dtype)
        np.maximum(u, 0, out=g[:, :HIDDEN])
        g[:, HIDDEN:] = h[:, :WIDTH]
        top, part = g @ w["o"], np.empty((count, SLOTS), unit.dtype)
        top += w["ob"]
        for k, own in parts:
            np.matmul(g[own], w["p"][k], out=part[own])
            part[own] += w["pb"][k]
        loss = 0.0
        for logits, true in ((top, group), (part, slot)):  # which become the gradients of the logits
            if shift:
                logits -= logits.max(1, keepdims=True)
            value = logits[at, true].sum(dtype=np.float64)
            np.exp(logits, out=logits)
            total = logits @ np.ones(logits.shape[1], unit.dtype)
            loss += np.log(total).sum(dtype=np.float64) - value
            logits *= (1 / (total * count))[:, None]
            logits[at, true] -= unit.dtype.type(1 / count)
        grad = {"o": g.T @ top, "ob": np.ones(count, unit.dtype) @ top, "p": np.zeros_like(w["p"]), "pb": np.zeros_like(w["pb"])}
        dg = top @ w["o"].T
        for k, own in parts:
            grad["p"][k], grad["pb"][k] = g[own].T @ part[own], part[own].sum(0)
            dg[own] += part[own] @ w["p"][k].T
        du = dg[:, :HIDDEN] * (u > 0)
        grad |= {"f": h.T @ du, "fb": np.ones(count, unit.dtype) @ du}
        dh = du @ w["f"].T
        dh[:, :WIDTH] += dg[:, HIDDEN:]
        back = np.zeros((len(flat), 2 * WIDTH), unit.dtype)
        back[rows] = dh
        da = back[:, WIDTH:] * weight
        fall = np.einsum("ij,ij->i", da, a).reshape(n, STRIDE, 1)
        da = da.reshape(n, STRIDE, WIDTH)
        dvi = (score.transpose(0, 2, 1) @ da).reshape(-1, WIDTH)
        ds = da @ vi.transpose(0, 2, 1)
        ds -= fall
        ds *= score
        grad["near"] = np.bincount(self.distance.ravel(), ds.sum(0).ravel(), WINDOW).astype(unit.dtype)
        dqi, dki = (ds @ ki).reshape(-1, WIDTH) * unit, (ds.transpose(0, 2, 1) @ qi).reshape(-1, WIDTH)
        x, xq = np.take(e, place.ravel(), 0), np.take(e, last.ravel(), 0)
        grad |= {"q": xq.T @ dqi, "k": x.T @ dki, "v": x.T @ dvi}
        dx = dki @ w["k"].T
        dx += dvi @ w["v"].T
        dx.reshape(n, WINDOW, WIDTH)[:, lead:] += (dqi @ w["q"].T + back[:, :WIDTH]).reshape(n, STRIDE, WIDTH)
        return float(loss / count), grad | {"e": (used, np.add.reduceat(np.take(dx, order, 0), first, axis=0))}

    def train(self, sequences: list[np.ndarray], steps: int = STEPS, seed: int = SEED) -> list[float]:
        """Steps over windows drawn from a few sequences."""
        if not sequences:
            return []
        inputs, targets, _ = self.windows(sequences)
        rng = np.random.default_rng(seed)
        return self.descend(inputs, targets, (rng.integers(0, len(inputs), min(BATCH, len(inputs))) for _ in range(steps)), steps, RATE)

    def descend(self, inputs: np.ndarray, targets: np.ndarray, picks: Iterator[np.ndarray], steps: int, rate: float) -> list[float]:
        """Adam with a rate that falls to zero. Embeddings are moved where they were used."""
        self.prepared = None
        m = {k: np.zeros_like(x) for k, x in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        losses = []
        for t, pick in enumerate(picks, 1):
            loss, grad = self.step(inputs[pick], targets[pick])
            losses.append(loss)
            now = float(rate * (1 - (t - 1) / steps) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t))
            for k, g in grad.items():
                rows, g = g if k == "e" else (slice(None), g)
                mean, square = m[k][rows], v[k][rows]  # views, except of embeddings
                mean *= 0.9
                mean += 0.1 * g
                square *= 0.99
                square += 0.01 * g * g
                if k == "e":
                    m[k][rows], v[k][rows] = mean, square
                change = np.sqrt(square)
                change += 1e-8
                np.divide(mean, change, out=change)
                change *= now
                self.w[k][rows] -= change
        return losses

    def flat(self) -> np.ndarray:
        """All weights in one vector."""
        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)])

    def set_flat(self, values: np.ndarray) -> None:
        self.prepared, at = None, 0
        for k in sorted(self.w):
            n = self.w[k].size
            self.w[k] = values[at : at + n].reshape(self.w[k].shape).astype(np.float32)
            at += n

    def _prepare(self) -> tuple:
        """What depends on one id alone, for every id."""
        w = self.w
        bias = np.where(self.future, np.float32(-1e9), w["near"][self.distance])
        return w["e"] @ w["q"] / np.float32(np.sqrt(WIDTH)), w["e"] @ w["k"], w["e"] @ w["v"], w["e"] @ w["f"][:WIDTH] + w["fb"], bias

    def token_logs(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each id, one sequence after another.

        The same sums as forward's: what depends on one id alone is looked up by id, and logits are not shifted before exp();
        they are small in a trained model, and a block where one overflows is done again as in training, with shifted ones.
        """
        if self.prepared is None:
            self.prepared = self._prepare()
        inputs, targets, _ = self.windows(sequences)
        out = []
        for start in range(0, len(inputs), BLOCK):
            ids_in, flat = inputs[start : start + BLOCK], targets[start : start + BLOCK].ravel()
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                result = self._block(ids_in, flat)
            out.append(result if np.isfinite(result).all() else self._shifted(ids_in, flat))
        return np.concatenate(out) if out else np.zeros(0)

    def _shifted(self, ids_in: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """One block of windows by forward()."""
        g, real = self.forward(ids_in)[0], np.flatnonzero(flat < self.pad)
        ids, out = flat[real], np.empty(len(real))
        for k, (i, x) in enumerate(zip(ids, g[real], strict=True)):
            m, s = self.group[i], self.slot[i]
            first, second = x @ self.w["o"] + self.w["ob"], x @ self.w["p"][m] + self.w["pb"][m]
            out[k] = first[m] - np.logaddexp.reduce(first.astype(np.float64)) + second[s] - np.logaddexp.reduce(second.astype(np.float64)) + self.within[i]
        return out

    def _block(self, ids_in: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """One block of windows."""
        q, k, v, x_part, bias = self.prepared
        w, lead = self.w, WINDOW - STRIDE
        last = ids_in[:, lead:]
        score = np.take(q, last, 0) @ np.take(k, ids_in, 0).transpose(0, 2, 1)
        score += bias
        np.exp(score, out=score)
        begins = np.flatnonzero(ids_in[:, 0] == self.pad)
        score[begins] *= (ids_in[begins] != self.pad)[:, None, :]
        a = (score @ np.take(v, ids_in, 0)).reshape(-1, WIDTH)
        a /= (score.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32) + np.float32(1e-30))[:, None]
        real = np.flatnonzero(flat < self.pad)
        group = self.group[flat[real]]
        order = np.argsort(group.astype(np.int16), kind="stable")
        rows = real[order]
        ids, group, source, at = flat[rows], group[order], last.ravel()[rows], np.arange(len(rows))
        g = np.empty((len(rows), HIDDEN + WIDTH), np.float32)
        u = np.take(a, rows, 0) @ w["f"][WIDTH:]
        u += np.take(x_part, source, 0)
        np.maximum(u, 0, out=g[:, :HIDDEN])
        g[:, HIDDEN:] = np.take(w["e"], source, 0)
        top, part = g @ w["o"], np.empty((len(rows), SLOTS), np.float32)
        top += w["ob"]
        bounds = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        for m in range(GROUPS):
            own = slice(bounds[m], bounds[m + 1])
            if bounds[m] < bounds[m + 1]:
                np.matmul(g[own], w["p"][m], out=part[own])
                part[own] += w["pb"][m]
        value = self.within[ids]
        for logits, true in ((top, group), (part, self.slot[ids])):
            value += logits[at, true]
            np.exp(logits, out=logits)
            value -= np.log(logits @ np.ones(logits.shape[1], np.float32))
        result = np.empty(len(rows))
        result[order] = value
        return result


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over a column text: counted in slices of the texts, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in numbered(batch.column(0), COUNT_CHARS):
                n = np.bincount(found.number, minlength=len(found.distinct))
                yield pa.RecordBatch.from_arrays([found.distinct.cast(pa.large_binary()).cast(pa.binary()), pa.array(n)], ["word", "n"])

    return texts.mapInArrow(tidy(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def subword_counts(counted: DataFrame, path: str, size: int) -> np.ndarray:
    """Uses of each subword id in all counted words: one row for each id comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = SubwordTable(path)
        total = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                first, length, ids = table.find(part.column(0).cast(pa.string()).to_pylist())
                stop = np.cumsum(length)
                flat = ids[np.repeat(first - stop + length, length) + np.arange(stop[-1])]
                total += np.bincount(flat, np.repeat(part.column(1).to_numpy(), length), size).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in counted.mapInArrow(tidy(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def start_model(sample: list[str | None], counts: np.ndarray, path: str) -> Attention:
    """Weights from the sample's first texts, whole, until they have START_IDS ids."""
    table, fitting, left = SubwordTable(path), [], START_IDS
    for text in sample:
        if left <= 0:
            break
        w = words(text)
        table.add(set(w))
        fitting.append(table.sequence(w))
        left -= len(fitting[-1])
    model = Attention(counts, fitting)
    model.train(fitting)
    return model


def rounds_of(keys: np.ndarray, numbers: np.ndarray, draw: int) -> np.ndarray:
    """A round for each numbered segment of a text with that key; from ROUNDS on, none."""
    return (textops.mix(textops.mix(keys.astype(np.int64).view(np.uint64)) + numbers.astype(np.uint64)) % np.uint64(draw)).astype(np.int64)


def drawn_segments(text_words: list[bytes], key: int, draw: int) -> list[tuple[int, int]]:
    """(round, segment) of the segments of a text: with as many rounds as `draw`, each segment is in one."""
    number = np.arange(len(text_words) // SEGMENT + 1)  # the last has the end
    place = rounds_of(np.full(len(number), key), number, draw)
    some = np.flatnonzero(place < ROUNDS)
    return list(zip(place[some].tolist(), some.tolist(), strict=True))


def training_windows(train: DataFrame, model: Attention, path: str, draw: int) -> DataFrame:
    """(round, n, inputs, targets): windows of the drawn segments of every training text, many to a row."""
    pad, begin, kind = model.pad, model.begin, model.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = SubwordTable(path)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for found in numbered(batch.column(1)):
                ids, place = table.stream(found, [begin])
                segments = np.diff(found.bounds) // SEGMENT + 1
                row = np.repeat(np.arange(found.rows), segments)
                number = np.arange(len(row)) - np.repeat(np.cumsum(segments) - segments, segments)
                low = place[found.bounds[row] + row + number * SEGMENT]  # where its first id stands; place has an end after the words of each row
                last = number == segments[row] - 1
                high = np.append(low[1:], len(ids))  # a segment goes on to the next one, or to the end of its text
                high[last] = place[found.bounds[row[last] + 1] + row[last]] + 1
                which = rounds_of(keys[found.at + row], number, draw)
                for k in range(ROUNDS):
                    own = np.flatnonzero(which == k)
                    blocks = -(-(high[own] - low[own]) // STRIDE)
                    of = np.repeat(own, blocks)
                    base = low[of] + (np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * STRIDE
                    for at in range(0, len(of), ROW_WINDOWS):
                        some, first = of[at : at + ROW_WINDOWS], base[at : at + ROW_WINDOWS, None]
                        source, target = first - 1 + np.arange(STRIDE - WINDOW, STRIDE), first + np.arange(STRIDE)
                        before, beyond = low[some, None] - 1, high[some, None]
                        inputs = np.where((source >= before) & (source < beyond - 1), ids[np.clip(source, 0, len(ids) - 1)], pad)
                        targets = np.where(target < beyond, ids[np.minimum(target, len(ids) - 1)], pad)
                        yield pa.RecordBatch.from_pylist([{"round": k, "n": len(some), "inputs": inputs.astype(kind).tobytes(), "targets": targets.astype(kind).tobytes()}], schema=packed)

    packed = pa.schema([("round", pa.int32()), ("n", pa.int64()), ("inputs", pa.binary()), ("targets", pa.binary())])
    return train.select(F.xxhash64("doc_id"), "text").mapInArrow(tidy(run), "round int, n long, inputs binary, targets binary")


def average_round(windows: DataFrame, model: Attention) -> None:
    """One round: a pass of Adam in each task over its windows, from the model's weights, and the mean of what they find."""
    shared = windows.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keep_freed()
        own, rng, n, held = copy.deepcopy(shared.value), np.random.default_rng(SEED + TaskContext.get().partitionId()), 0, []

        def pass_over() -> int:
            """One pass over the windows held."""
            inputs = np.concatenate([np.frombuffer(a, own.kind).reshape(-1, WINDOW) for a, _ in held])
            targets = np.concatenate([np.frombuffer(b, own.kind).reshape(-1, STRIDE) for _, b in held])
            held.clear()
            steps = -(-len(inputs) // LOCAL_BATCH)
            own.descend(inputs, targets, iter(np.array_split(rng.permutation(len(inputs)), steps)), steps, LOCAL_RATE)
            return len(inputs)

        for batch in batches:
            for i in range(batch.num_rows):
                held.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()))
                if sum(len(a) for a, _ in held) >= CHUNK * WINDOW * np.dtype(own.kind).itemsize:
                    n += pass_over()
        if held:
            n += pass_over()
        if not n:
            return
        for k, piece in enumerate(np.array_split(own.flat(), PIECES)):
            yield pa.RecordBatch.from_pylist([{"piece": k, "n": n, "body": piece.tobytes()}], schema=packed)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                k, n, body = (batch.column(c)[i].as_py() for c in range(3))
                sums = total.setdefault(k, [0, 0.0])
                sums[0] += n
                sums[1] = sums[1] + n * np.frombuffer(body, np.float32).astype(np.float64)
        for k, (n, sums) in total.items():
            yield pa.RecordBatch.from_pylist([{"piece": k, "n": n, "body": (sums / n).astype(np.float32).tobytes()}], schema=packed)

    packed = pa.schema([("piece", pa.int32()), ("n", pa.int64()), ("body", pa.binary())])
    schema = "piece int, n long, body binary"
    found = windows.mapInArrow(tidy(learn), schema).repartition(PIECES, "piece").mapInArrow(tidy(add), schema).collect()
    if found:
        model.set_flat(np.concatenate([np.frombuffer(r.body, np.float32) for r in sorted(found, key=lambda r: r.piece)]))


def fit_model(train: DataFrame, counts: np.ndarray, n_texts: int, path: str, draw: int | None = None) -> Attention:
    """A start on a few texts, then rounds over the drawn windows of all texts."""
    chance = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, START_DOCS / max(n_texts, 1)))
    sample = [r.text for r in train.where(chance).orderBy("doc_id", "text").limit(2 * START_DOCS).collect()]
    model = start_model(sample, counts, path)
    windows = materialise(training_windows(train, model, path, draw or DRAW), "training-windows")
    for k in range(ROUNDS):
        average_round(windows.where(F.col("round") == k).select("inputs", "targets"), model)
    return model


def score_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    path = path or bpe.default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = docs.where(~held_out(F.col("doc_id")))
    counted = materialise(word_counts(train.select("text")), "word-counts")
    n_texts = train.count()
    sums = counted.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    train_tokens, distinct = int(sums.n) + n_texts, int(sums.v) + (n_texts > 0)
    common = {bytes(r.word): r.n for r in counted.orderBy(F.desc("n"), "word").limit(COMMON).select("word", "n").toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(common)  # at most COMMON words

    size = SubwordTable(path).size
    model = fit_model(train, np.append(subword_counts(counted, path, size), n_texts).astype(np.float64), n_texts, path)
    model.prepared = None  # each worker makes its own
    weights = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary's embeddings

    names = ["row_id", "doc_id", "n_tokens", "n_known", "log_sum", "score", "rare_words", "rare_uses"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keep_freed()
        table, common = SubwordTable(path), pa.array(list(shared.value), pa.large_binary())
        counts = np.array([*shared.value.values(), 0], np.float64)  # the last is for words that are not common
        log1, model, row_id = np.log10(counts + 1.0), weights.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in numbered(batch.column(1)):
                at, rows, length = part.at, part.rows, np.diff(part.bounds)
                ids, where = table.stream(part, [])
                stops = where[part.bounds[1:] + np.arange(rows)] + 1
                score = np.add.reduceat(model.token_logs(np.split(ids, stops[:-1])), np.concatenate([[0], stops[:-1]])) / LOG10
                known = pc.index_in(part.distinct.cast(pa.large_binary()), common).fill_null(len(counts) - 1).to_numpy()
                place, doc = known[part.number], np.repeat(np.arange(rows), length)
                rare = np.flatnonzero(place == len(counts) - 1)
                pair, uses = np.unique(doc[rare] * (len(known) + 1) + part.number[rare], return_counts=True)  # each rare word of each text
                cut = pa.array(np.searchsorted(pair // (len(known) + 1), np.arange(rows + 1)), pa.int32())
                rare_words = part.distinct.take(pa.array(pair % (len(known) + 1))).cast(pa.large_binary()).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row_id, row_id + rows)), batch.column(0).slice(at, rows), pa.array(length + 1),
                        pa.array(length - np.bincount(doc[rare], minlength=rows) + (n_texts > 0)),
                        pa.array(np.bincount(doc, log1[place], rows) + np.log10(n_texts + 1.0)), pa.array(score),  # rare words add log10(1)
                        pa.ListArray.from_arrays(cut, rare_words), pa.ListArray.from_arrays(cut, pa.array(uses.astype(np.int64))),
                    ], names,
                )
                row_id += rows

    schema = "row_id long, doc_id long, n_tokens long, n_known long, log_sum double, score double, rare_words array<binary>, rare_uses array<long>"
    scored = materialise(docs.mapInArrow(tidy(run), schema), "scored")
    rare = scored.select("row_id", F.explode(F.arrays_zip("rare_words", "rare_uses")).alias("r")).select("row_id", F.col("r.rare_words").alias("word"), F.col("r.rare_uses").alias("uses"))
    sums = rare.join(counted, "word").groupBy("row_id").agg(F.sum("uses").alias("known"), F.sum(F.col("uses") * F.log10(F.col("n") + 1.0)).alias("logs"))
    out = scored.drop("rare_words", "rare_uses").join(sums, "row_id", "left")
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("log_sum") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(train_tokens + 1.0 * (distinct + 1)))).alias("base_score"),
        "score",
    )
