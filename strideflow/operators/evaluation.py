"""Evaluation records of reconstructed features: one pass over valid frames and one aggregate for each group.

Frames hold the target, the prediction (arrays of one width) and a mask; degenerate rotation columns give null angles, which no mean counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow.functions.geometry import matrix_from_6d
from strideflow.operators.metrics import joint_distances, ratio, wrapped_difference

#: Channels of a robot frame.
POSITION, ROTATION, JOINTS, LINEAR, ANGULAR, JOINT_SPEED, CONTACT = (0, 3), (3, 9), (9, 38), (38, 41), (41, 44), (44, 73), (73, 75)


def _cut(a: Column, bounds: tuple[int, int]) -> Column:
    return F.slice(a, bounds[0] + 1, bounds[1] - bounds[0])


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _distances(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(y - x))


def _geodesic(a: Column, b: Column) -> Column:
    """The angle between two rotations, as matrices in one row-major array each."""
    trace = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2)))


def _turn(m: Column, v: Column) -> Column:
    return F.array(*[sum((F.get(m, F.lit(3 * i + k)) * F.get(v, F.lit(k)) for k in range(1, 3)), F.get(m, F.lit(3 * i)) * F.get(v, F.lit(0))) for i in range(3)])


def _contacts(prefix: str, channels: int) -> tuple[list[Column], dict[str, Column]]:
    """Counts over all contact channels, and the scores made of them."""
    is_on = lambda side, k: F.get(side, F.lit(k)) >= 0.5
    count = lambda test, name: sum((F.count_if(test(k)) for k in range(1, channels)), F.count_if(test(0))).alias(name)
    t, p = F.col(f"{prefix}t"), F.col(f"{prefix}p")
    counts = [count(lambda k: is_on(t, k) & is_on(p, k), "tp"), count(lambda k: ~is_on(t, k) & is_on(p, k), "fp"), count(lambda k: is_on(t, k) & ~is_on(p, k), "fn")]
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return counts, {"contact_precision": ratio(tp, tp + fp), "contact_recall": ratio(tp, tp + fn), "contact_f1": ratio(2 * tp, 2 * tp + fp + fn)}


def robot_reconstruction(frames: DataFrame, group: list[str], t: str, target: str, prediction: str, mask: str) -> DataFrame:
    """(group, n, mae, rmse, max_abs, joint_mae, joint_degrees, worst_joint, worst_joint_mae, ade, fde, rotation, local_velocity, world_velocity, angular_velocity,
    joint_velocity, yaw, height, contact scores). The worst joint is the first of the greatest error; fde is the last valid frame's."""
    rows = frames.where(mask).select(*group, F.col(t).alias("_t"), F.col(target).cast("array<double>").alias("_a"), F.col(prediction).cast("array<double>").alias("_b"))
    rows = rows.withColumns({"_ma": matrix_from_6d(_cut(F.col("_a"), ROTATION)), "_mb": matrix_from_6d(_cut(F.col("_b"), ROTATION)), "_d": _distances(F.col("_a"), F.col("_b"))})
    a, b, d, ma, mb = (F.col(c) for c in ("_a", "_b", "_d", "_ma", "_mb"))
    yaw = lambda m: F.atan2(F.get(m, F.lit(2)), F.get(m, F.lit(8)))
    mean_of = {"mae": d, "local_velocity": _cut(d, LINEAR), "angular_velocity": _cut(d, ANGULAR), "joint_velocity": _cut(d, JOINT_SPEED), "world_velocity": _distances(_turn(ma, _cut(a, LINEAR)), _turn(mb, _cut(b, LINEAR)))}
    own = {
        "ade": F.sqrt(F.aggregate(_cut(d, POSITION), F.lit(0.0), lambda s, x: s + x * x)), "rotation": _geodesic(ma, mb), "yaw": F.abs(wrapped_difference(yaw(mb), yaw(ma))),
        "height": F.get(d, F.lit(1)), "_square": _mean(F.transform(d, lambda x: x * x)), "_max": F.array_max(d),
    }
    rows = rows.select(*group, "_t", _cut(d, JOINTS).alias("_j"), _cut(a, CONTACT).alias("_t_t"), _cut(b, CONTACT).alias("_t_p"), *[_mean(c).alias(k) for k, c in mean_of.items()], *[c.alias(k) for k, c in own.items()])
    counts, scores = _contacts("_t_", CONTACT[1] - CONTACT[0])
    joints = F.array(*[F.avg(F.get("_j", F.lit(k))) for k in range(JOINTS[1] - JOINTS[0])]).alias("joint_mae")
    averages = [F.avg(k).alias(k) for k in (*mean_of, "ade", "rotation", "yaw", "height")]
    out = rows.groupBy(*group).agg(F.count("*").alias("n"), *averages, F.sqrt(F.avg("_square")).alias("rmse"), F.max("_max").alias("max_abs"), F.max_by("ade", "_t").alias("fde"), joints, *counts)
    worst = F.array_max("joint_mae")
    return out.withColumns({"joint_degrees": F.transform("joint_mae", F.degrees), "worst_joint_mae": worst, "worst_joint": (F.array_position("joint_mae", worst) - 1).cast("int"), **scores}).drop("tp", "fp", "fn")


def human_reconstruction(frames: DataFrame, group: list[str], target: str, prediction: str, mask: str, position: tuple[int, int], rotation: tuple[int, int], contact: tuple[int, int]) -> DataFrame:
    """(group, n, mae, rmse, max_abs, mpjpe, root_relative_mpjpe, rotation, contact scores); the bounds are the layout's channels."""
    joints, turns = (position[1] - position[0]) // 3, (rotation[1] - rotation[0]) // 6
    rows = frames.where(mask).select(*group, F.col(target).cast("array<double>").alias("_a"), F.col(prediction).cast("array<double>").alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(turns - 1)), lambda k: F.struct(F.slice(a, k * 6 + rotation[0] + 1, 6).alias("a"), F.slice(b, k * 6 + rotation[0] + 1, 6).alias("b")))
    matrices = F.transform(pairs, lambda p: F.struct(matrix_from_6d(p["a"]).alias("a"), matrix_from_6d(p["b"]).alias("b")))
    d = _distances(a, b)
    at, to = _cut(a, position), _cut(b, position)
    rows = rows.select(
        *group, _mean(d).alias("mae"), _mean(F.transform(d, lambda x: x * x)).alias("_square"), F.array_max(d).alias("_max"), _mean(joint_distances(at, to, joints)).alias("mpjpe"),
        _mean(joint_distances(at, to, joints, True)).alias("root_relative_mpjpe"), _mean(F.transform(matrices, lambda m: _geodesic(m["a"], m["b"]))).alias("rotation"), _cut(a, contact).alias("_t_t"), _cut(b, contact).alias("_t_p"),
    )
    counts, scores = _contacts("_t_", contact[1] - contact[0])
    averages = [F.avg(k).alias(k) for k in ("mae", "mpjpe", "root_relative_mpjpe", "rotation")]
    return rows.groupBy(*group).agg(F.count("*").alias("n"), *averages, F.sqrt(F.avg("_square")).alias("rmse"), F.max("_max").alias("max_abs"), *counts).withColumns(scores).drop("tp", "fp", "fn")
