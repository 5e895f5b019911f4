"""Streaming tokens: frames come in chunks, and each sequence emits a token for every four frames.

State is bounded: the frames that wait for a full group, and the history that a token may read (the receptive field). A group is
complete by its count, not by time, so a micro-batch may end anywhere. With a state store in the checkpoint location a restarted
query goes on exactly where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "sample_id long, k long, token_id long"
STATE = "history array<double>, consumed long, emitted long"


def encode_stream(frames: DataFrame, encode: Callable[[np.ndarray], np.ndarray], history: int, group: int = 4) -> DataFrame:
    """(sample_id, k, token_id) of a stream of (sample_id, t, value).

    encode maps the frames up to a group's end (`history` of them at most, and the group) to the group's token; the last group of
    an unfinished sequence waits. Rows of a micro-batch are put in order of t; frames already consumed are ignored.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, consumed, emitted = state.get if state.exists else ([], 0, 0)
        new = pd.concat(list(chunks)).sort_values("t")
        new = new[new["t"] >= consumed]
        values = [*past, *new["value"]]
        first = consumed - len(past)  # frame number of values[0]
        consumed += len(new)
        tokens = []
        while (emitted + 1) * group <= consumed:
            end = (emitted + 1) * group - first
            tokens.append((key[0], emitted, int(encode(np.array(values[max(0, end - group - history) : end], float)))))
            emitted += 1
        keep = consumed - emitted * group + history
        state.update((values[-keep:] if keep else [], consumed, emitted))
        yield pd.DataFrame(tokens, columns=["sample_id", "k", "token_id"])

    return frames.select("sample_id", "t", "value").groupBy("sample_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def encode_batch(frames: DataFrame, encode: Callable[[np.ndarray], np.ndarray], history: int, group: int = 4) -> DataFrame:
    """The same of a finished table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("t")["value"].to_numpy(float)
        rows = [(pdf["sample_id"].iloc[0], k, int(encode(values[max(0, (k + 1) * group - group - history) : (k + 1) * group]))) for k in range(len(values) // group)]
        return pd.DataFrame(rows, columns=["sample_id", "k", "token_id"])

    return frames.select("sample_id", "t", "value").groupBy("sample_id").applyInPandas(run, OUTPUT)
