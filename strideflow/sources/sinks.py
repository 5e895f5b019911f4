"""Sinks: JSON lines, checksums, normalisers, deployment archives."""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, order: str) -> int:
    """Sorted JSON lines; the number of rows comes from the write itself."""
    from pyspark.sql import Observation

    seen = Observation("rows")
    df.orderBy(order).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").json(path)
    return seen.get["n"]


PIECE = 1 << 20


def checksums(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256) of every file below root, paths relative to it (a root that is a file gives its own name).

    Spark lists the files without reading them (its scan leaves empty ones out, so these come from the listing); files whose names begin with _ or . do not count. Executors read each by path in pieces of 1 MiB, so a file of any size takes the memory of a
    piece. Files are dealt to tasks by size: those of one size class are spread evenly, so no task has all the large ones.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = listed.select("path", "length")
    named = spark.createDataFrame([(unquote(p),) for p in listed.inputFiles()], "path string").join(files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path")), "path", "left_anti")
    files = files.unionByName(named.withColumn("length", F.lit(0).cast("long")))
    spread = F.row_number().over(Window.partitionBy(F.floor(F.log2(F.col("length") + 1))).orderBy("length", "path"))
    dealt = files.withColumn("deal", spread).repartition(spark.sparkContext.defaultParallelism, "deal")
    below = re.compile("^.*" + re.escape(re.sub("^[a-z0-9]+:/+", "/", root).rstrip("/")) + "/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": [below.sub("", p) if below.match(p) else p.rsplit("/", 1)[-1] for p in batch["path"]], "length": batch["length"], "sha256": [file_digest(p) for p in batch["path"]]})

    return dealt.mapInPandas(run, "path string, length long, sha256 string")


def file_digest(uri: str) -> str:
    """sha256 of a file by its URI, read in pieces: local folders by path, other stores by the file system that Arrow has for them."""
    import pyarrow.fs as stores

    store, path = (stores.LocalFileSystem(), re.sub("^file:/+", "/", uri)) if uri.startswith(("file:", "/")) else stores.FileSystem.from_uri(uri)
    out = hashlib.sha256()
    with store.open_input_stream(path, buffer_size=PIECE) as stream:
        while piece := stream.read(PIECE):
            out.update(piece)
    return out.hexdigest()


def content_digest(mean: list[float], std: list[float]) -> str:
    return hashlib.sha256(np.asarray(mean, "<f8").tobytes() + np.asarray(std, "<f8").tobytes()).hexdigest()


def canonical_digest(value: object) -> str:
    """sha256 of a value's JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def write_normalizer(stats: DataFrame, path: str, schema_id: str, source: str, fps: float) -> None:
    """stats: (dim, mean, std), as wide as a frame. Written beside and renamed, so no reader sees half a file."""
    rows = sorted(stats.select("dim", "mean", "std").collect())
    mean, std = [r[1] for r in rows], [r[2] for r in rows]
    body = {"schema_id": schema_id, "source_dataset": source, "fps": fps, "mean": mean, "std": std, "content_sha256": content_digest(mean, std)}
    with open(f"{path}.part", "w", encoding="utf-8") as file:
        json.dump(body, file, sort_keys=True)
    os.replace(f"{path}.part", path)


def motion_archive(arrays: dict[str, np.ndarray], fps: float) -> bytes:
    """A deflated archive of one .npy member for each array, and fps."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, values in [*arrays.items(), ("fps", np.float64(fps))]:
            member = io.BytesIO()
            np.save(member, np.asarray(values), allow_pickle=False)
            z.writestr(f"{name}.npy", member.getvalue())
    return out.getvalue()
