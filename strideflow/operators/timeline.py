"""Timelines and resampling: grids, as-of brackets, linear interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideflow.constants import TIMELINE_TOLERANCE_S
from strideflow.functions import geometry


def grid_size(first: Column, last: Column, fps: float) -> Column:
    """Points of the inclusive grid from first to last; the small addition keeps a last point that rounding would lose."""
    return (F.floor((last - first) * F.lit(float(fps)) + F.lit(1e-9)) + 1).cast("long")


def grid(extents: DataFrame, fps: float, first: str = "first_s", last: str = "last_s") -> DataFrame:
    """(…, i, at): the grid points of each extent."""
    n = grid_size(F.col(first), F.col(last), fps)
    return extents.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("at", F.col(first) + F.col("i") / F.lit(float(fps)))


def brackets(points: DataFrame, targets: DataFrame, sample: str, time: str, value: Column, at: str) -> DataFrame:
    """(sample, x, b): for each target the source at or before it and the one after that, as b (s, v, next_s, next_v).

    As-of brackets without a range join: sources and targets are put in one order per sample, and one last() in either direction carries a source to the
    targets, in time linear in the points. Both windows are by sample, so the merge shuffles once. value may be of any type. All targets are sorted; those of a regular
    grid come from grid_brackets, which sorts sources alone.
    """
    marked = points.select(sample, F.col(time).alias("x"), F.lit(0).alias("is_target"), value.alias("v"))
    wanted = targets.select(sample, F.col(at).alias("x"), F.lit(1).alias("is_target"), F.lit(None).cast(marked.schema["v"].dataType).alias("v"))
    merged = marked.unionByName(wanted).withColumn("source", F.when(F.col("is_target") == 0, F.struct(F.col("x").alias("s"), "v")))
    before = Window.partitionBy(sample).orderBy("x", "is_target").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(sample).orderBy(F.desc("x"), F.desc("is_target")).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last("source", ignorenulls=True)
    merged = merged.withColumn("p", carried.over(before)).withColumn("q", carried.over(after)).where("is_target = 1")
    return merged.select(sample, "x", F.struct(F.col("p.s").alias("s"), F.col("p.v").alias("v"), F.col("q.s").alias("next_s"), F.col("q.v").alias("next_v")).alias("b"))


def grid_brackets(points: DataFrame, fps: float, sample: str, time: str, value: Column, ties: tuple[str, ...] = ()) -> DataFrame:
    """(sample, i, x, b): brackets at the points of `grid` from a sample's first source to its last; of sources of one time the last by ties counts.

    Each source makes the points up to the next one where it stands, so points are neither sorted nor shuffled nor held, however many they are. Their numbers are found by division, with one more on
    either side, and then compared as times.
    """
    own = Window.partitionBy(sample)
    c, order = F.col, own.orderBy(time, *ties)
    held = F.struct(c(time).alias("s"), value.alias("v"), F.lead(time).over(order).alias("next_s"), F.lead(value).over(order).alias("next_v"))
    rows = points.select(sample, held.alias("b"), F.min(time).over(own).alias("first"), F.max(time).over(own).alias("last"))
    end = grid_size(c("first"), c("last"), fps) - 1
    place = lambda x: (x - c("first")) * F.lit(float(fps))
    low = F.greatest(F.floor(place(c("b.s"))).cast("long") - 1, F.lit(0).cast("long"))
    high = F.coalesce(F.least(F.ceil(place(c("b.next_s"))).cast("long") + 1, end), end)
    near = rows.withColumn("i", F.explode(F.sequence(low, F.greatest(low, high)))).withColumn("x", c("first") + c("i") / F.lit(float(fps)))
    return near.where((c("i") <= end) & (c("x") >= c("b.s")) & (c("b.next_s").isNull() | (c("x") < c("b.next_s")))).select(sample, "i", "x", "b")


def _linear() -> Column:
    """The value at x between a bracket's ends; the last value from the last source on."""
    share = (F.col("x") - F.col("b.s")) / (F.col("b.next_s") - F.col("b.s"))
    inside = F.col("b.v") + (F.col("b.next_v") - F.col("b.v")) * share
    return F.when(F.col("b.next_s").isNull() | (F.col("x") == F.col("b.s")), F.col("b.v")).otherwise(inside)


def _turned(both: DataFrame, *kept: Column | str, rotation: str) -> DataFrame:
    share = (F.col("x") - F.col("b.s")) / (F.col("b.next_s") - F.col("b.s"))
    both = both.withColumns({"share": share, "ends": F.when(F.col("b.next_s").isNotNull() & (F.col("x") != F.col("b.s")), F.col("b"))})
    turned = geometry.slerp(F.col("ends.v"), F.col("ends.next_v"), F.col("share"))
    return both.select(*kept, F.when(F.col("ends").isNull(), F.col("b.v")).otherwise(turned).alias(rotation))


def resample_linear(points: DataFrame, targets: DataFrame, sample: str, time: str = "s", value: str = "value", at: str = "at") -> DataFrame:
    """(sample, at, value): linear interpolation at each target; the last value from the last source on."""
    return brackets(points, targets, sample, time, F.col(value).cast("double"), at).select(sample, F.col("x").alias(at), _linear().alias(value))


def grid_linear(points: DataFrame, fps: float, sample: str, time: str = "s", value: str = "value", at: str = "at", ties: tuple[str, ...] = ()) -> DataFrame:
    """(sample, i, at, value): the same at the points of each sample's own grid."""
    return grid_brackets(points, fps, sample, time, F.col(value).cast("double"), ties).select(sample, "i", F.col("x").alias(at), _linear().alias(value))


def resample_rotations(points: DataFrame, targets: DataFrame, sample: str, time: str = "s", rotation: str = "rotation", at: str = "at") -> DataFrame:
    """(sample, at, rotation): quaternions (x, y, z, w) at each target, along the shorter arc between those on either side; the last one from the last source on.

    Sources are brought to length 1 first, so results have length 1.
    """
    return _turned(brackets(points, targets, sample, time, geometry.normalize(F.col(rotation)), at), sample, F.col("x").alias(at), rotation=rotation)


def grid_rotations(points: DataFrame, fps: float, sample: str, time: str = "s", rotation: str = "rotation", at: str = "at", ties: tuple[str, ...] = ()) -> DataFrame:
    """(sample, i, at, rotation): the same at the points of each sample's own grid."""
    unit = points.withColumn(rotation, geometry.normalize(F.col(rotation)))  # once a source
    return _turned(grid_brackets(unit, fps, sample, time, F.col(rotation), ties), sample, "i", F.col("x").alias(at), rotation=rotation)


def duration_tolerance(fps_a: Column, fps_b: Column) -> Column:
    """How far two durations may differ: a fixed time, or a frame of each where that is longer."""
    return F.greatest(F.lit(TIMELINE_TOLERANCE_S), 1.0 / fps_a + 1.0 / fps_b)


def common_timeline(pairs: DataFrame, target_fps: float) -> DataFrame:
    """Adds duration_error, tolerance, common_end, points and reason (null if the pair has a common timeline).

    pairs: frames_a, fps_a, frames_b, fps_b. A duration is frames / fps, an extent ends at (frames - 1) / fps.
    """
    a, b = F.col("frames_a") / F.col("fps_a"), F.col("frames_b") / F.col("fps_b")
    end = F.least((F.col("frames_a") - 1) / F.col("fps_a"), (F.col("frames_b") - 1) / F.col("fps_b"))
    out = pairs.withColumns({"duration_error": F.abs(a - b), "tolerance": duration_tolerance(F.col("fps_a"), F.col("fps_b")), "common_end": end})
    out = out.withColumn("points", grid_size(F.lit(0.0), F.col("common_end"), target_fps))
    reason = (
        F.when((F.least("frames_a", "frames_b") < 2) | (F.least("fps_a", "fps_b") <= 0), "timeline_shape")
        .when(F.col("duration_error") > F.col("tolerance"), "timeline_mismatch")
        .when(F.col("points") < 2, "timeline_too_short")
    )
    return out.withColumn("reason", reason)


def clip_bounds(start: Column, end: Column, human_frames: Column, robot_frames: Column) -> tuple[Column, Column, Column]:
    """A clip in 20 Hz human frames as robot frames, in integer arithmetic, and the robot's rate."""
    first = F.floor(start * robot_frames / human_frames).cast("long")
    last = F.least(F.ceil(end * robot_frames / human_frames).cast("long"), robot_frames)
    return first, last, F.lit(20.0) * robot_frames / human_frames
