"""Reconstruction, contact, loss and corpus metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, zero where that is undefined."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def contact_metrics(df: DataFrame, target: Column, prediction: Column, group: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    t, p = target >= threshold, prediction >= threshold
    counts = df.groupBy(*(group or [])).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def feature_errors(df: DataFrame, target: str, prediction: str, group: list[str] | None = None, mask: Column | None = None) -> DataFrame:
    """(group, n, mae, rmse, max_abs) over valid frames and all channels."""
    rows = df if mask is None else df.where(mask)
    d = rows.select(*(group or []), F.explode(F.zip_with(target, prediction, lambda a, b: a.cast("double") - b.cast("double"))).alias("d"))
    return d.groupBy(*(group or [])).agg(F.count("d").alias("n"), F.avg(F.abs("d")).alias("mae"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.max(F.abs("d")).alias("max_abs"))


def joint_distances(target: Column, prediction: Column, joints: int, root_relative: bool = False) -> Column:
    """Euclidean distance of each joint of two flat position arrays."""

    def at(a: Column, j: Column, k: int) -> Column:
        x = F.get(a, j * 3 + k).cast("double")
        return x - F.get(a, F.lit(k)).cast("double") if root_relative else x

    def distance(j: Column) -> Column:
        return F.sqrt(sum(((at(target, j, k) - at(prediction, j, k)) * (at(target, j, k) - at(prediction, j, k)) for k in range(3)), F.lit(0.0)))

    return F.transform(F.sequence(F.lit(0), F.lit(joints - 1)), distance)


def mean_joint_error(df: DataFrame, target: str, prediction: str, joints: int, group: list[str] | None = None) -> DataFrame:
    """(group, mpjpe, root_relative_mpjpe)."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / joints
    rows = df.select(*(group or []), mean(joint_distances(F.col(target), F.col(prediction), joints)).alias("d"), mean(joint_distances(F.col(target), F.col(prediction), joints, True)).alias("r"))
    return rows.groupBy(*(group or [])).agg(F.avg("d").alias("mpjpe"), F.avg("r").alias("root_relative_mpjpe"))


def worst_channel(df: DataFrame, target: str, prediction: str, group: list[str] | None = None) -> DataFrame:
    """(group, joint, mae): the channel of the greatest mean error, the first on ties. Errors are compared as rounded to 9 places."""
    d = df.select(*(group or []), F.posexplode(F.zip_with(target, prediction, lambda a, b: F.abs(a.cast("double") - b.cast("double")))).alias("joint", "e"))
    per = d.groupBy(*(group or []), "joint").agg(F.round(F.avg("e"), 9).alias("mae"))
    worst = F.min(F.struct((-F.col("mae")).alias("e"), F.col("joint").alias("joint")))
    return per.groupBy(*(group or [])).agg(worst.alias("w")).select(*(group or []), F.col("w.joint").alias("joint"), (-F.col("w.e")).alias("mae"))


def smooth_l1(d: Column, beta: float = 1.0) -> Column:
    return F.when(F.abs(d) < beta, 0.5 * d * d / beta).otherwise(F.abs(d) - 0.5 * beta)


def masked_velocity_loss(frames: DataFrame, window, target: str, prediction: str, mask: str, velocity_weight: float = 0.5) -> DataFrame:
    """One row (reconstruction, velocity, loss): smooth L1 over valid frames, and over changes between adjacent valid frames."""
    pair = F.col(mask) & F.coalesce(F.lag(mask).over(window), F.lit(False))
    dv = (F.col(prediction) - F.lag(prediction).over(window)) - (F.col(target) - F.lag(target).over(window))
    rows = frames.select(F.when(F.col(mask), smooth_l1(F.col(prediction) - F.col(target))).alias("r"), F.when(pair, smooth_l1(dv)).alias("v"))
    out = rows.agg(F.avg("r").alias("reconstruction"), F.coalesce(F.avg("v"), F.lit(0.0)).alias("velocity"))
    return out.withColumn("loss", F.col("reconstruction") + velocity_weight * F.col("velocity"))


def component_loss(frames: DataFrame, window, target: str, prediction: str, mask: str, components: list[tuple[int, int, float]], temporal: list[tuple[int, int]], temporal_weight: float = 0.5) -> DataFrame:
    """One row (reconstruction, temporal, loss) over vectors: smooth L1 of each channel range, weighted, over valid frames; and of the changes of
    some ranges between adjacent valid frames. All ranges are averaged in one aggregate."""

    def error(a: Column, b: Column, start: int, stop: int) -> Column:
        part = lambda x: F.transform(F.slice(x, start + 1, stop - start), lambda v: v.cast("double"))
        return F.aggregate(F.zip_with(part(a), part(b), lambda x, y: smooth_l1(x - y)), F.lit(0.0), lambda s, x: s + x) / (stop - start)

    change = lambda c: F.zip_with(c, F.lag(c).over(window), lambda x, y: x.cast("double") - y.cast("double"))
    pair = F.col(mask) & F.coalesce(F.lag(mask).over(window), F.lit(False))
    rows = frames.select(F.col(mask).alias("_m"), target, prediction, F.when(pair, change(F.col(target))).alias("_dt"), F.when(pair, change(F.col(prediction))).alias("_dp"))
    weights = sum(w for *_, w in components)
    kept = [F.avg(F.when(F.col("_m"), error(F.col(prediction), F.col(target), a, b))) * (w / weights) for a, b, w in components]
    moved = [F.avg(error(F.col("_dp"), F.col("_dt"), a, b)) / len(temporal) for a, b in temporal]
    out = rows.agg(sum(kept[1:], kept[0]).alias("reconstruction"), F.coalesce(sum(moved[1:], moved[0]), F.lit(0.0)).alias("temporal"))
    return out.withColumn("loss", F.col("reconstruction") + temporal_weight * F.col("temporal"))


def wrapped_difference(a: Column, b: Column) -> Column:
    """The difference of two angles in (-pi, pi]."""
    return F.atan2(F.sin(a - b), F.cos(a - b))


def final_error(error: str, t: str) -> Column:
    """The error of the last frame."""
    return F.max_by(error, t)


def mean_of_batches(df: DataFrame, batch: str, loss: str) -> DataFrame:
    """The mean over batches of each batch's mean: a short batch weighs as much as a full one."""
    return df.groupBy(batch).agg(F.avg(loss).alias("m")).agg(F.avg("m").alias("loss"))


def changed_tokens(a: DataFrame, b: DataFrame, keys: list[str], token: str = "token_id", latent: str | None = None) -> DataFrame:
    """One row (compared, changed, max_difference) for two runs over the same positions."""
    j = a.alias("a").join(b.alias("b"), keys)
    d = F.max(F.abs(F.col(f"a.{latent}") - F.col(f"b.{latent}"))) if latent else F.lit(0.0)
    return j.agg(F.count("*").alias("compared"), F.count_if(F.col(f"a.{token}") != F.col(f"b.{token}")).alias("changed"), F.coalesce(d, F.lit(0.0)).alias("max_difference"))
