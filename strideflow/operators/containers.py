"""Source adapters: manifest records joined with the arrays that their references name, as input of tracks.prepare.

A container row is (path, locator, row, arrays, names): the flat, row-major arrays and the string lists of one sequence. `locator` is empty where a
file holds one sequence; of rows with one (path, locator) the greatest `row` counts, so `row` has to tell them apart. Containers are Parquet
tables or .npz files, never pickles. A record that cannot be loaded is a row with its reason, the first that its source's checks give:
source_dataset, source_locator, source_nonfinite (an absent array too), bone_seed_smpl_schema, g1_dof_order, source_frame_range.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.functions.kernels import BodyTree
from strideflow.operators import tracks
from strideflow.sources.prepared import ARCHIVE_ERRORS
from strideflow.sources.shared import materialise

CONTAINER = "path string, locator string, row bigint, arrays map<string,array<double>>, names map<string,array<string>>"
_FLAT = "array<double>"


def npz_containers(spark: SparkSession, root: str) -> DataFrame:
    """One container row for each .npz file below root. A file that is no readable archive has no arrays, so its records get a reason."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                arrays, names = {}, {}
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        for key in z.files:
                            if z[key].dtype.kind in "US":
                                names[key] = z[key].astype(str).ravel().tolist()
                            else:
                                arrays[key] = z[key].astype(float).ravel().tolist()
                except ARCHIVE_ERRORS:
                    arrays, names = {}, {}
                rows.append((path, "", 0, arrays, names))
            yield pd.DataFrame(rows, columns=["path", "locator", "row", "arrays", "names"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(root)
    return files.select("path", "content").mapInPandas(load, CONTAINER)


def attach(records: DataFrame, containers: DataFrame, side: str) -> DataFrame:
    """Adds <side>_arrays and <side>_names: of the record's locator, else of the whole file; null where neither is there.

    Keys are resolved over the narrow columns first, so each container row that is wanted moves once.
    """
    keys = containers.groupBy("path", "locator").agg(F.max("row").alias("row"))
    places = F.array_distinct(F.array(F.coalesce(F.col(f"{side}.locator"), F.lit("")), F.lit("")))
    wanted = records.select("sample_id", F.col(f"{side}.path").alias("path"), F.posexplode(places).alias("choice", "locator"))
    found = wanted.join(keys, ["path", "locator"]).groupBy("sample_id").agg(F.min(F.struct("choice", "path", "locator", "row")).alias("k"))
    rows = found.select("sample_id", "k.path", "k.locator", "k.row").join(containers, ["path", "locator", "row"])
    return records.join(rows.select("sample_id", F.col("arrays").alias(f"{side}_arrays"), F.col("names").alias(f"{side}_names")), "sample_id", "left")


def _nonfinite(*arrays: Column) -> Column:
    bad = [F.coalesce(F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) for a in arrays]
    return F.when(F.exists(F.array(*bad), lambda b: b), "source_nonfinite")


def load_pairs(records: DataFrame, containers: DataFrame, dof_names: tuple[str, ...]) -> DataFrame:
    """(sample_id, human, human_fps, root, rotation, dof, robot_fps, bodies, body_names, reason): arrays flat, rotations x, y, z, w.

    records: sample_id, source_dataset, human and g1 as in a manifest; sample_id is unique.
    """
    both = attach(attach(records, containers, "human"), containers, "g1")
    human, robot = (lambda k: F.col("human_arrays")[k]), (lambda k: F.col("g1_arrays")[k])
    names, bodies = F.col("g1_names")["dof_names"], F.col("g1_names")["body_names"]
    n_bodies = F.size(bodies)

    def outside(a: Column, width: Column | int, side: str) -> Column:
        start, stop = F.col(f"{side}.frame_start"), F.col(f"{side}.frame_end")
        inside = (start >= 0) & (stop >= start) & (F.size(a) >= stop * width)
        return F.coalesce(_nonfinite(a), F.when(~F.coalesce(inside, F.lit(False)), "source_frame_range"))

    def cut(a: Column, width: Column | int, side: str) -> Column:
        start, stop = F.col(f"{side}.frame_start"), F.col(f"{side}.frame_end")
        return F.slice(a, start * width + 1, (stop - start) * width)

    def each(a: Column, width: Column | int, part: Callable[[Column, Column], Column]) -> Column:
        """part(array, first place) of every frame, in one flat array."""
        n = (F.size(a) / width).cast("int")
        return F.flatten(F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: part(a, i * width))).otherwise(F.array().cast(f"array<{_FLAT}>")))

    def turned(a: Column, width: Column | int = 4) -> Column:
        """w, x, y, z to x, y, z, w."""
        return each(a, width, lambda x, at: F.array(*[F.get(x, at + k) for k in (1, 2, 3, 0)]))

    absent = lambda side: F.when(F.col(f"{side}_arrays").isNull(), "source_locator")
    joints, pose, moved = human("smpl_joints"), human("pose_aa"), human("transl")
    shaped = (F.size(joints) % 72 == 0) & (F.size(pose) == F.size(joints)) & (F.size(moved) * 24 == F.size(joints))
    n_dof = len(dof_names)
    reasons = {
        "Bone-Seed": [absent("human"), absent("g1"), _nonfinite(joints, pose, moved), F.when(~shaped, "bone_seed_smpl_schema"),
                      outside(robot("root_trans_offset"), 3, "g1"), outside(robot("root_rot"), 4, "g1"), outside(robot("dof"), n_dof, "g1")],
        "Inter-X": [absent("human"), outside(human("joints"), 66, "human"), absent("g1"),
                    outside(robot("root_pos"), 3, "g1"), outside(robot("root_rot"), 4, "g1"), outside(robot("dof_pos"), n_dof, "g1")],
        "HumanML3D": [absent("human"), outside(human("joints"), 66, "human"), absent("g1"), F.when(~F.coalesce(names == F.array(*map(F.lit, dof_names)), F.lit(False)), "g1_dof_order"),
                      outside(robot("body_positions"), n_bodies * 3, "g1"), outside(robot("body_rotations"), n_bodies * 4, "g1"), outside(robot("dof_positions"), n_dof, "g1")],
    }
    at_bodies = cut(robot("body_positions"), n_bodies * 3, "g1")
    own = {
        "Bone-Seed": (each(joints, 72, lambda x, at: F.slice(x, at + 1, 66)), cut(robot("root_trans_offset"), 3, "g1"), cut(robot("root_rot"), 4, "g1"), cut(robot("dof"), n_dof, "g1")),
        "Inter-X": (cut(human("joints"), 66, "human"), cut(robot("root_pos"), 3, "g1"), turned(cut(robot("root_rot"), 4, "g1")), cut(robot("dof_pos"), n_dof, "g1")),
        "HumanML3D": (cut(human("joints"), 66, "human"), each(at_bodies, n_bodies * 3, lambda x, at: F.slice(x, at + 1, 3)), turned(cut(robot("body_rotations"), n_bodies * 4, "g1"), n_bodies * 4), cut(robot("dof_positions"), n_dof, "g1")),
    }
    is_of = lambda d: F.coalesce(F.col("source_dataset") == d, F.lit(False))
    reason = F.when(~F.coalesce(F.col("source_dataset").isin(*reasons), F.lit(False)), "source_dataset")
    checked = both.withColumn("reason", F.coalesce(reason, *[F.when(is_of(d), F.coalesce(*r)) for d, r in reasons.items()]))
    good = F.col("reason").isNull()
    choose = lambda k: F.coalesce(*[F.when(good & is_of(d), v[k]) for d, v in own.items()])
    with_bodies = good & is_of("HumanML3D")
    return checked.select(
        "sample_id", choose(0).alias("human"), F.col("human.fps").alias("human_fps"), choose(1).alias("root"), choose(2).alias("rotation"), choose(3).alias("dof"),
        F.col("g1.fps").alias("robot_fps"), F.when(with_bodies, at_bodies).alias("bodies"), F.when(with_bodies, bodies).alias("body_names"), "reason",
    )


def prepare_corpus(records: DataFrame, containers: DataFrame, limits: list[tuple[float, float]], tree: BodyTree, dof_names: tuple[str, ...]) -> DataFrame:
    """The batch job with one row a record, see tracks.prepared_rows. prepare_frames gives the long layout, which sources.corpus.write takes."""
    return tracks.prepared_rows(*prepare_frames(records, containers, limits, tree, dof_names))


def prepare_frames(records: DataFrame, containers: DataFrame, limits: list[tuple[float, float]], tree: BodyTree, dof_names: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The batch job: load, then prepare; see tracks.prepare for what it gives. The loaded pairs are written to the shared folder, so containers are read once."""
    return tracks.prepare(materialise(load_pairs(records, containers, dof_names), "pairs"), limits, tree)
