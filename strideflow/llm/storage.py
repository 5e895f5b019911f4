"""Where intermediate tables go: the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only where the setting is unset, as in tests, is one made here and set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="strideflow-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back, which cuts its lineage.

    The table outlives the loss of any executor, since every executor can read it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished jobs, which it does once the driver has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same function for mapInArrow, whose worker gives freed memory back to the system after each task.

    Workers live on between tasks and stages, and what their allocators hold would add up beside the executor's heap.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def keep_freed() -> None:
    """Lets the worker's allocator keep what arrays free for the next ones, instead of mapping and clearing pages anew for each; `tidy` gives it back after the task."""
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        for parameter in (-3, -1):  # the sizes from which a block is mapped by itself, and from which the free end of the heap is given back
            ctypes.CDLL(None).mallopt(parameter, 1 << 28)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
