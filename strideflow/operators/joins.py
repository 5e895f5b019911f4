"""Pairing: inner and anti joins of two key sets, unique-candidate lookup, optional lookup arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow.constants import TARGET_FPS


def matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "inner")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of each side that have no partner."""
    return left.join(right, keys, "left_anti"), right.join(left, keys, "left_anti")


def inventory(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: matched keys, keys on the left alone, keys on the right alone; one join for all three."""
    both = left.select(*keys).distinct().withColumn("_l", F.lit(1)).join(right.select(*keys).distinct().withColumn("_r", F.lit(1)), keys, "full_outer")
    return both.agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"),
        F.count_if(F.col("_r").isNull()).alias("left_only"),
        F.count_if(F.col("_l").isNull()).alias("right_only"),
    )


def unique_candidate(rows: DataFrame, candidates: DataFrame, key: str, missing: str, ambiguous: str) -> DataFrame:
    """Adds candidates and reason: null where exactly one candidate has the key. Candidates are counted before the join."""
    counts = candidates.groupBy(key).agg(F.count("*").alias("candidates"))
    joined = rows.join(counts, key, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return joined.withColumn("reason", F.when(F.col("candidates") == 0, missing).when(F.col("candidates") > 1, ambiguous))


def lookup_arrays(rows: DataFrame, lookups: list[tuple[DataFrame, str]], key: str, name: str, element: str) -> DataFrame:
    """Left lookups of array columns, concatenated; an absent one is empty."""
    for k, (df, column) in enumerate(lookups):
        rows = rows.join(df.select(key, F.col(column).alias(f"_a{k}")), key, "left")
    empty = F.array().cast(f"array<{element}>")
    parts = [F.coalesce(f"_a{k}", empty) for k in range(len(lookups))]
    return rows.withColumn(name, F.concat(*parts)).drop(*[f"_a{k}" for k in range(len(lookups))])


def manifest_duration_gate(frames_a: Column, fps_a: Column, frames_b: Column, fps_b: Column) -> Column:
    """Whether two durations agree to a frame of the slower side."""
    return F.abs(frames_a / fps_a - frames_b / fps_b) <= F.greatest(1.0 / fps_a, 1.0 / fps_b) + 1e-6


def token_rate(fps: float = TARGET_FPS, frames_per_token: int = 4) -> float:
    return fps / frames_per_token
