"""Ordered quality gates: metrics of each sequence, then the first gate that fails is its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideflow import constants as C
from strideflow.operators.selection import percentiles


def first_failure(gates: list[tuple[str, Column]]) -> Column:
    """The reason of the first gate that fails, in the order given; null if none does."""
    out = F.when(F.lit(False), "")
    for reason, failed in gates:
        out = out.when(F.coalesce(failed, F.lit(False)), reason)
    return out


#: The gates in the order in which they are applied: reason, measure, least and greatest value that pass. The first six are on a raw sequence, the others on an aligned pair.
BOUNDS = [
    ("source_nonfinite", "finite", True, None),
    ("g1_quaternion_norm", "quaternion_norm_error", None, C.QUATERNION_NORM_TOLERANCE),
    ("g1_dof_limit", "dof_violation", None, C.DOF_LIMIT_TOLERANCE_RAD),
    ("human_height", "stature", C.MIN_HEIGHT_M, C.MAX_HEIGHT_M),
    ("human_bone_length", "bone_cv", None, C.MAX_BONE_LENGTH_CV),
    ("human_joint_speed", "max_joint_speed", None, C.MAX_JOINT_SPEED_M_S),
    ("g1_root_speed", "max_root_speed", None, C.MAX_ROOT_SPEED_M_S),
    ("g1_root_angular_speed", "max_angular_speed", None, C.MAX_ANGULAR_SPEED_RAD_S),
    ("g1_dof_speed", "max_dof_speed", None, C.MAX_DOF_SPEED_RAD_S),
    ("pair_energy_alignment", "energy_correlation", C.MIN_ENERGY_CORRELATION, None),
    ("g1_foot_penetration", "foot_penetration", None, C.MAX_FOOT_PENETRATION_M),
]
RAW = 6


def _gate(reason: str, measure: str, least: float | bool | None, greatest: float | None) -> tuple[str, Column]:
    c = F.col(measure)
    if least is True:
        return reason, ~c
    return reason, F.lit(False) | (c < least if least is not None else F.lit(False)) | (c > greatest if greatest is not None else F.lit(False))


def raw_gates() -> list[tuple[str, Column]]:
    """Gates on the measures of a raw sequence (columns of that name)."""
    return [_gate(*b) for b in BOUNDS[:RAW]]


def aligned_gates() -> list[tuple[str, Column]]:
    """Gates on the measures of an aligned pair."""
    return [_gate(*b) for b in BOUNDS[RAW:]]


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite: NaN sorts above infinity."""
    return F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))


def limit_violation(values: Column, limits: list[tuple[float, float]]) -> Column:
    """How far an array goes beyond its limits at most; zero within them."""
    table = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in limits])
    over = F.zip_with(values, table, lambda x, limit: F.greatest(limit["lo"] - x, x - limit["hi"]))
    return F.greatest(F.array_max(over), F.lit(0.0))


def guarded_corr(x: str, y: str, still: float = C.STILL_STD) -> Column:
    """Correlation; 1 where either side hardly varies, so stillness is no failure."""
    moving = (F.stddev_pop(x) > still) & (F.stddev_pop(y) > still)
    return F.when(moving, F.corr(x, y)).otherwise(F.lit(1.0))


def near_floor_slide(height: str, speed: str, floor: str, near: float = C.NEAR_FLOOR_M) -> Column:
    """95th percentile of the speed of frames near the floor; zero if there are none."""
    return F.coalesce(F.percentile(F.when(F.col(height) - F.col(floor) <= near, F.col(speed)), 0.95), F.lit(0.0))


def penetration(height: str) -> Column:
    return F.greatest(F.lit(0.0), -F.min(height))


def foot_contact(frames: DataFrame, sample: str, t: str, height: str, speed: Column, max_height: float = C.CONTACT_HEIGHT_M, max_speed: float = C.CONTACT_SPEED_M_S) -> DataFrame:
    """Adds floor_y and contact: low over the sample's floor (2nd percentile of all its feet) and slow."""
    floor = F.percentile(height, C.FLOOR_PERCENTILE).over(Window.partitionBy(sample))
    out = frames.withColumn("_speed", speed).withColumn("floor_y", floor)
    return out.withColumn("contact", (F.col(height) - F.col("floor_y") <= max_height) & (F.col("_speed") <= max_speed)).drop("_speed")


def human_contact(squared_displacement: Column, threshold: float = 0.002) -> Column:
    """Human feet: squared forward displacement of a frame strictly below the threshold."""
    return squared_displacement < threshold


def route(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Accepted and quarantined rows."""
    return df.where(F.col(reason).isNull()), df.where(F.col(reason).isNotNull())


def summary(df: DataFrame, group: list[str], metrics: list[str]) -> DataFrame:
    """(group, metric, n, minimum, median, p95, maximum), percentiles with linear interpolation.

    There are few groups and each may be large, so percentiles are selected in rounds and not by an aggregate that holds a group's values. A metric
    without a value in a group has n 0 and nulls.
    """
    tall = df.select(*group, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m")).select(*group, "m.metric", "m.v")
    keys = [*group, "metric"]
    found = percentiles(tall, keys, "v", [0.5, 0.95]).select(*keys, "n", "minimum", F.col("p0").alias("median"), F.col("p1").alias("p95"), "maximum")
    empty = tall.groupBy(*keys).agg(F.count("v").alias("n")).where("n = 0")
    return found.unionByName(empty, allowMissingColumns=True)
