"""Motion sources: pair files, manifests, split files, captions, normalisers. Pickle files are never opened."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.sources.prepared import ARCHIVE_ERRORS

PAIR_NAME = r"(G\d{3}T\d{3}A\d{3}R\d{3})_(actor|reactor)\.(npz|pkl)$"
_REF = "path string, format string, locator string, fps double, frame_start int, frame_end int, fields array<string>"
MANIFEST = (
    "schema_version int, sample_id string, source_dataset string, source_sequence_id string, source_group_id string, augmentation string, split_original string, split string, duration_sec double, "
    f"human struct<{_REF}>, g1 struct<{_REF}, fps_file_value double, source_fps int, human_source_frames int, g1_source_frames int>, "
    "texts array<struct<text string, kind string, source_field string, start_t double, end_t double>>, has_text boolean, human_signature string, same_motion_evidence string"
).replace(" string, format", ": string, format")
ACTOR = {"root_pos": (3,), "root_rot": (4,), "pose_body": (69,), "joints_pos": (24, 3)}
REACTOR = {"root_pos": (3,), "root_rot": (4,), "dof_pos": (29,), "joints_pos": (20, 3)}
LOADED = "sequence_id string, role string, frames int, fps double, arrays map<string,array<double>>, reason string"


def discover_pairs(spark: SparkSession, root: str) -> DataFrame:
    """(sequence_id, ext, state, actor_path, reactor_path) by file name alone; an .npz half does not match a .pkl half."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    named = files.select("path", *[F.regexp_extract("path", PAIR_NAME, k).alias(n) for k, n in ((1, "sequence_id"), (2, "role"), (3, "ext"))]).where("sequence_id <> ''")
    sides = named.groupBy("sequence_id", "ext").agg(F.max(F.when(F.col("role") == "actor", F.col("path"))).alias("actor_path"), F.max(F.when(F.col("role") == "reactor", F.col("path"))).alias("reactor_path"))
    state = F.when(F.col("reactor_path").isNull(), "actor_only").when(F.col("actor_path").isNull(), "reactor_only").otherwise("matched")
    return sides.withColumn("state", state)


def _half(content: bytes, role: str) -> tuple:
    """(frames, fps, arrays, reason) of one file; its fields have to be exactly those of the role."""
    shapes = ACTOR if role == "actor" else REACTOR
    extra = {"fps", "betas", "gender"} if role == "actor" else {"fps"}
    try:
        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            data = {k: z[k] for k in z.files}
    except ARCHIVE_ERRORS:
        return 0, None, {}, "unreadable"
    if set(data) != set(shapes) | extra:
        return 0, None, {}, "fields"
    frames, fps = len(data["root_pos"]), float(data["fps"])
    if frames < 2 or any(data[k].shape != (frames, *s) for k, s in shapes.items()):
        return frames, fps, {}, "shape"
    if not all(np.isfinite(data[k]).all() for k in shapes) or not np.isfinite(fps):
        return frames, fps, {}, "nonfinite"
    if fps <= 0:
        return frames, fps, {}, "fps"
    if (np.abs((data["root_rot"].astype(float) ** 2).sum(1) - 1) > 2e-4).any():
        return frames, fps, {}, "quaternion_norm"
    return frames, fps, {k: data[k].astype(float).ravel().tolist() for k in shapes}, None


def load_pairs(spark: SparkSession, root: str) -> DataFrame:
    """One row for each matched .npz pair: both halves' arrays, row-major, or the reason for its rejection."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, r, *(lambda f, p, a, e: (f, p, a, e))(*_half(c, r))) for i, r, c in zip(batch["sequence_id"], batch["role"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["sequence_id", "role", "frames", "fps", "arrays", "reason"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(root)
    named = files.select(F.regexp_extract("path", PAIR_NAME, 1).alias("sequence_id"), F.regexp_extract("path", PAIR_NAME, 2).alias("role"), "content").where("sequence_id <> ''")
    halves = named.mapInPandas(load, LOADED)
    a, r = (halves.where(F.col("role") == role).drop("role") for role in ("actor", "reactor"))
    side = lambda df, p: df.select("sequence_id", *[F.col(c).alias(f"{p}_{c}") for c in ("frames", "fps", "arrays", "reason")])
    both = side(a, "actor").join(side(r, "reactor"), "sequence_id")
    reason = F.coalesce("actor_reason", "reactor_reason", F.when(F.col("actor_frames") != F.col("reactor_frames"), "frame_count").when(F.col("actor_fps") != F.col("reactor_fps"), "fps"))
    return both.withColumn("reason", reason).drop("actor_reason", "reactor_reason")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL manifest with its fixed schema; a line that is no such object fails the read."""
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)


def fixed_splits(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_id, split) of a split file; ids have to be unique, not empty, and as many as it says."""
    part = lambda s: F.transform(F.col(f"splits.{s}"), lambda i: F.struct(i.alias("sequence_id"), F.lit(s).alias("split")))
    schema = "schema_id string, schema_version int, source struct<sequence_count: long>, splits struct<train: array<string>, val: array<string>, test: array<string>>"
    raw = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", "true").json(path)
    rows = raw.select(F.explode(F.concat(part("train"), part("val"), part("test"))).alias("r"), F.col("source.sequence_count").alias("expected")).select("r.*", "expected")
    check = rows.agg(F.count("*").alias("n"), F.count_distinct("sequence_id").alias("d"), F.max("expected").alias("e"), F.count_if(F.trim("sequence_id") == "").alias("blank")).first()
    if check.n != check.d or check.blank or check.n != check.e:
        raise ValueError(f"split file: {check.n} ids, {check.d} distinct, {check.blank} blank, {check.e} expected")
    return rows.select("sequence_id", "split")


def csv_index(spark: SparkSession, path: str, file_column: str) -> DataFrame:
    """A CSV index with the stem of its file column; for equal stems the last row by name of the file wins."""
    rows = spark.read.option("header", "true").csv(path)
    stem = F.regexp_replace(F.regexp_extract(file_column, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    packed = rows.select(stem.alias("stem"), F.struct(*rows.columns).alias("row"))
    return packed.groupBy("stem").agg(F.max_by("row", F.col(f"row.{file_column}")).alias("row")).select("stem", "row.*")


def normalizer(path: str, schema_id: str) -> dict:
    """Stored statistics; a wrong schema or a digest that does not fit its content raises."""
    from strideflow.sources.sinks import content_digest

    with open(path, encoding="utf-8") as file:
        stats = json.load(file)
    if stats["schema_id"] != schema_id or stats["content_sha256"] != content_digest(stats["mean"], stats["std"]):
        raise ValueError("normaliser does not fit")
    return stats
