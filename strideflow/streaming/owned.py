"""Streams whose state belongs to one encoder, and prefixes that grow by an observation.

Both keep keyed state in the state store of the query's checkpoint (RocksDB; `session` sets it), so a query that is started again goes on where it
stopped, and both put out a row with a reason for what they refuse: nothing vanishes. Rows of one key in a micro-batch are taken in the order of `seq`.

Chunks. A state is used once: each accepted chunk or reset consumes it and makes the next, one generation on. A row names the owner and generation that
it was made for. What does not fit the current state is refused and changes nothing:

    foreign    another owner's state          consumed   the state was used by an earlier row
    reset      the state was given up by a reset    unknown    a state that has not been made, or has expired
    mask       values and mask differ in length, or either is null      nonfinite  a value that counts is null or not finite (one that is masked out is read as 0)

Prefixes. The accepted pairs of a key's rows in a micro-batch are appended to a list state, one element each but in one request, and put out with their places; the state is read once, and only
where a row asks for the prefix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strideflow.constants import CODEBOOK_SIZE, FRAMES_PER_TOKEN

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOKENS = "sample_id long, generation long, k long, token_id long, token_mask boolean, reason string"
PREFIXES = "sample_id long, seq long, place long, human long, robot long, human_prefix array<long>, robot_prefix array<long>, refused long, reason string"


def session(spark: SparkSession) -> SparkSession:
    """Chooses the state store that these operators need, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class Chunks(StatefulProcessor):
    """State: generation, the generation of the last reset, frames taken and tokens put out since then, and the last frames with their masks."""

    def __init__(self, owner: str, encode: Callable[[np.ndarray], int], history: int, ttl_ms: int | None):
        self.owner, self.encode, self.past, self.ttl = owner, encode, history, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stream", "generation long, reset long, taken long, emitted long, frames array<double>, mask array<boolean>", self.ttl)

    def refusal(self, row: Any, generation: int, reset: int) -> str | None:
        if row.owner != self.owner:
            return "foreign"
        if row.generation != generation:
            return "unknown" if row.generation is None or row.generation > generation else "reset" if row.generation < reset else "consumed"
        if row.kind == "reset":
            return None
        if row.values is None or row.mask is None or len(row.values) != len(row.mask):
            return "mask"
        counts = [v for v, m in zip(row.values, row.mask, strict=True) if m]
        return None if all(v is not None and np.isfinite(v) for v in counts) else "nonfinite"

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        generation, reset, taken, emitted, frames, mask = self.state.get() if self.state.exists() else (0, 0, 0, 0, [], [])
        frames, mask, out, group = list(frames), list(mask), [], FRAMES_PER_TOKEN
        for row in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            if reason := self.refusal(row, generation, reset):
                out.append((key[0], row.generation, None, None, None, reason))
                continue
            if row.kind == "reset":
                generation, taken, emitted, frames, mask = generation + 1, 0, 0, [], []
                reset = generation
                continue
            frames += [float(v) if v is not None and np.isfinite(v) else 0.0 for v in row.values]
            mask += [bool(m) for m in row.mask]
            taken += len(row.values)
            while (emitted + 1) * group <= taken:
                end = (emitted + 1) * group - taken + len(frames)
                token = self.encode(np.array(frames[max(0, end - group - self.past) : end], float))
                out.append((key[0], generation, emitted, int(token), any(mask[end - group : end]), None))
                emitted += 1
            keep = taken - emitted * group + self.past
            frames, mask = (frames[-keep:], mask[-keep:]) if keep else ([], [])
            generation += 1
        self.state.update((generation, reset, taken, emitted, frames, mask))
        yield pd.DataFrame(out, columns=["sample_id", "generation", "k", "token_id", "token_mask", "reason"])

    def close(self) -> None:
        pass


def encode_chunks(chunks: DataFrame, owner: str, encode: Callable[[np.ndarray], int], history: int = 0, ttl_ms: int | None = None) -> DataFrame:
    """TOKENS of a stream of (sample_id, seq, owner, generation, kind, values, mask); kind is `frames` or `reset`.

    encode maps the frames up to a group's end, `history` of them at most before the group, to its token. A state unused for ttl_ms expires.
    """
    session(chunks.sparkSession)
    mode = "ProcessingTime" if ttl_ms else "None"
    columns = chunks.select("sample_id", "seq", "owner", "generation", "kind", "values", "mask")
    return columns.groupBy("sample_id").transformWithStateInPandas(Chunks(owner, encode, history, ttl_ms), TOKENS, "Append", mode)


class Prefixes(StatefulProcessor):
    """State: the pairs, one list element each, and the counts of accepted and refused ones with the last accepted seq."""

    def __init__(self, codes: int):
        self.codes = codes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pairs = handle.getListState("pairs", "human long, robot long")
        self.counts = handle.getValueState("counts", "accepted long, refused long, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        accepted, refused, last = self.counts.get() if self.counts.exists() else (0, 0, None)
        out: list[tuple] = []
        held: list[tuple] | None = None if accepted else []  # what the state held before these rows, read when first asked for
        new: list[tuple] = []
        for row in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            reason, place, human, robot, prefix = None, None, None, None, (None, None)
            if row.kind == "snapshot":
                held = list(self.pairs.get()) if held is None else held
                reason, place = (None if held or new else "empty"), accepted
                prefix = prefix if reason else tuple([p[side] for part in (held, new) for p in part] for side in (0, 1))
            else:
                known = [None if pd.isna(x) else int(x) for x in (row.human, row.robot)]
                bad = [x is None or not 0 <= x < self.codes for x in known]
                reason = "late" if last is not None and row.seq <= last else "human_range" if bad[0] else "robot_range" if bad[1] else None
                if reason:
                    refused += 1
                else:
                    human, robot = known
                    new.append((human, robot))
                    place, accepted, last = accepted, accepted + 1, row.seq
            out.append((key[0], row.seq, place, human, robot, *prefix, refused, reason))
        if new:
            self.pairs.appendList(new)
        self.counts.update((accepted, refused, last))
        frame = pd.DataFrame(out, columns=["sample_id", "seq", "place", "human", "robot", "human_prefix", "robot_prefix", "refused", "reason"])
        yield frame.astype({c: "Int64" for c in ("place", "human", "robot")})

    def close(self) -> None:
        pass


def grow_prefixes(rows: DataFrame, codes: int = CODEBOOK_SIZE) -> DataFrame:
    """PREFIXES of a stream of (sample_id, seq, kind, human, robot); kind is `pair` or `snapshot`.

    An accepted pair is put out with its place from 0; a snapshot with both prefixes and the place of the pair to come, or the reason `empty`. refused counts
    the key's refused pairs so far: `human_range` and `robot_range` (also null), and `late`, whose seq is not after that of the last accepted pair.
    """
    session(rows.sparkSession)
    return rows.select("sample_id", "seq", "kind", "human", "robot").groupBy("sample_id").transformWithStateInPandas(Prefixes(codes), PREFIXES, "Append", "None")
