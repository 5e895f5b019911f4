"""Parquet tables, read with column pruning and pushed filters left to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.operators.frames import frame_index


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def event_frames(spark: SparkSession, directory: str) -> DataFrame:
    """Events as motion: user is the sequence, the order of (ts, event_id) the frame, value the channel; s is seconds since 2024."""
    events = table(spark, directory, "events")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6
    return frame_index(events.select(F.col("user_id").alias("sample_id"), "event_id", "ts", "event_type", "value", "props", seconds.alias("s")), "sample_id", "ts", "event_id")
