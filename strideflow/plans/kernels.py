"""Queries that run kernels: what no SQL expresses (rows only), and streaming against batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strideflow.functions import kernels as K
from strideflow.plans.streams import in_parts
from strideflow.sources.sinks import checksums
from strideflow.sources.tables import event_frames, table
from strideflow.streaming import tokens

CATALOGUE: dict[str, tuple] = {}


def query(sql: str = ""):
    def add(f):
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return add


def _joints(values: np.ndarray) -> np.ndarray:
    """A synthetic skeleton of 22 joints that walks as the values say."""
    base = np.zeros((22, 3))
    for chain in K.CHAINS:
        for a, b in zip(chain[:-1], chain[1:], strict=True):
            base[b] = base[a] + 0.3 * np.array(K.REST_DIRECTIONS[b], float) + (0.05 if b in (14, 17, 19, 21) else 0.0)
    walk = np.cumsum(values)[:, None] / 5000.0 * np.array([1.0, 0.0, 0.5])
    return base[None] + walk[:, None]


def _per_sample(spark, d, run, schema):
    return event_frames(spark, d).select("sample_id", "t", "value").groupBy("sample_id").applyInPandas(lambda pdf: run(pdf.sort_values("t")), schema)


@query()
def kernel_ik_262(spark, d):
    """Human features of a synthetic walk for each user."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        placed, _ = K.place_human(_joints(pdf["value"].to_numpy()))
        features = K.human_features(placed) if len(placed) > 1 else np.zeros((0, 262))
        return pd.DataFrame({"sample_id": pdf["sample_id"].iloc[:1], "frames": [len(features)], "contacts": [int(features[:, 258:].sum())], "path_m": [round(float(np.linalg.norm(features[:, 66:69], axis=1).sum()), 4)]})

    return _per_sample(spark, d, run, "sample_id long, frames long, contacts long, path_m double")


@query()
def kernel_robot_75(spark, d):
    """Robot features of a synthetic drive, decoded again: round-trip and integration errors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["value"].to_numpy()
        n, yaw = len(v), np.cumsum(v) / 2000.0
        root = np.stack([np.cumsum(v) / 5000.0, np.full(n, 0.8), yaw * 0.1], 1)
        q = np.stack([np.zeros(n), np.sin(yaw / 2), np.zeros(n), np.cos(yaw / 2)], 1)
        dof = np.outer(np.sin(v), np.linspace(0, 0.1, 29))
        features, anchor = K.robot_features(root, q, dof, np.zeros((n, 2)), 20.0)
        back = K.robot_motion(features, anchor)
        return pd.DataFrame({"sample_id": pdf["sample_id"].iloc[:1], "frames": [n], "root_error": [round(float(np.abs(back[0] - root).max()), 6)], "dof_error": [round(float(np.abs(back[2] - dof).max()), 6)], "integration_error": [round(K.integration_error(features, 20.0), 6)]})

    return _per_sample(spark, d, run, "sample_id long, frames long, root_error double, dof_error double, integration_error double")


def _weights(feature_dim: int, width: int, code_dim: int, depth: int, seed: int = 0) -> dict:
    rng = np.random.default_rng(seed)
    conv = lambda i, o, k: (rng.standard_normal((o, i, k)) / np.sqrt(i * k), np.zeros(o))
    blocks = lambda: [{"first": conv(width, width, 3), "second": conv(width, width, 3)} for _ in range(depth)]
    return {"input": conv(feature_dim, width, 3), "stages": [{"down": conv(width, width, 4), "blocks": blocks()} for _ in range(2)], "output": conv(width, code_dim, 3)}


@query()
def conv_encode(spark, d):
    """Tokens of a causal convolution encoder with fixed weights and a fixed codebook."""
    weights, codes = _weights(2, 8, 4, 2), np.random.default_rng(1).standard_normal((256, 4))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["value"].to_numpy() / 50
        v = np.pad(v, (0, -len(v) % 4), "edge") if len(v) else v  # the last frame is repeated: a partial group has a token
        x = np.stack([v, np.diff(v, prepend=v[:1])], 1)
        ids = K.nearest_codes(K.conv_encode(x, weights), codes) if len(v) else []
        return pd.DataFrame({"sample_id": pdf["sample_id"].iloc[0], "k": range(len(ids)), "token_id": ids})

    return _per_sample(spark, d, run, "sample_id long, k long, token_id long")


_TOKENS = """WITH f AS (SELECT user_id AS sample_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events),
    n AS (SELECT sample_id, count(*) AS n FROM f GROUP BY 1)
    SELECT sample_id, t // 4 AS k, floor(round(sum(value), 6))::BIGINT % 256 AS token_id FROM f JOIN n USING (sample_id) WHERE t < n - n % 4 GROUP BY 1, 2"""


def _group_token(frames: np.ndarray) -> int:
    return int(np.floor(np.round(frames[-4:].sum(), 6))) % 256


@query(_TOKENS)
def batch_tokens(spark, d):
    return tokens.encode_batch(event_frames(spark, d), _group_token, 0)


@query(_TOKENS)
def stream_tokens_equals_batch(spark, d):
    """The same tokens from a stream of the frames in three parts, each taken by a query that is started anew and goes on from the state store."""
    frames = event_frames(spark, d).select("sample_id", F.col("t").cast("long").alias("t"), "value")
    return in_parts(frames, lambda s: tokens.encode_stream(s, _group_token, 0), tokens.OUTPUT, F.col("t") < 5, F.col("t").between(5, 7), F.col("t") >= 8)


@query()
def checksum_inventory(spark, d):
    """Every file of every table."""
    return checksums(spark, d)


@query("SELECT count(*) AS rows FROM region")
def region_rows(spark, d):
    return table(spark, d, "region").agg(F.count("*").alias("rows"))
