"""Small committed tables, and where intermediate ones go."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as `spark.checkpoint.dir` or `setCheckpointDir` names it. Only a local session that has neither gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="strideflow-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage; any executor can read it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def commit(spark: SparkSession, path: str, body: dict) -> None:
    """One JSON value in one file, which appears as a whole by a rename when Spark's job commits; an existing path fails."""
    spark.createDataFrame([(json.dumps(body, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def committed(spark: SparkSession, path: str) -> dict | None:
    """What `commit` wrote, or None if it did not finish."""
    try:
        rows = spark.read.option("wholetext", "true").text(path).collect()  # one row
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return json.loads(rows[0][0]) if rows else None
