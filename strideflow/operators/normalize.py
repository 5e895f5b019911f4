"""Normalisers: masked mean and population deviation of each channel, fitted on the training split, and their use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow.constants import STD_FLOOR


def fit_scalar(df: DataFrame, value: str, group: list[str] | None = None, mask: Column | None = None) -> DataFrame:
    rows = df if mask is None else df.where(mask)
    return rows.groupBy(*(group or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.greatest(F.stddev_pop(value), F.lit(STD_FLOOR)).alias("std"))


def fit_vector(df: DataFrame, vector: str, mask: Column | None = None, passthrough_from: int | None = None) -> DataFrame:
    """(dim, n, mean, std). Channels from `passthrough_from` on (contacts) get mean 0 and deviation 1."""
    rows = df if mask is None else df.where(mask)
    tall = rows.select(F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    out = tall.groupBy("dim").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(STD_FLOOR)).alias("std"))
    if passthrough_from is None:
        return out
    contact = F.col("dim") >= passthrough_from
    return out.withColumn("mean", F.when(contact, 0.0).otherwise(F.col("mean"))).withColumn("std", F.when(contact, 1.0).otherwise(F.col("std")))


def as_arrays(stats: DataFrame) -> DataFrame:
    """One row (mean, std) with arrays in order of dim: as wide as a frame, so it is broadcast."""
    s = F.sort_array(F.collect_list(F.struct("dim", "mean", "std")))
    return stats.agg(F.transform(s, lambda r: r["mean"]).alias("mean"), F.transform(s, lambda r: r["std"]).alias("std"))


def apply(df: DataFrame, vector: str, stats: DataFrame, inverse: bool = False) -> DataFrame:
    """(x - mean) / std of each channel, or its inverse; stats as as_arrays gives them."""
    step = (lambda x, s: x * s) if inverse else (lambda x, m: x - m)
    then = (lambda x, m: x + m) if inverse else (lambda x, s: x / s)
    first, second = ("std", "mean") if inverse else ("mean", "std")
    joined = df.crossJoin(F.broadcast(stats))  # one row
    value = F.transform(vector, lambda x: x.cast("double"))
    return joined.withColumn(vector, F.zip_with(F.zip_with(value, first, step), second, then)).drop("mean", "std")
