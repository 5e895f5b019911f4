"""Frame order, differences, padding and windows over the long layout (sample_id, t, value).

One window specification, (sample_id) ordered by t, serves all of them, so a chain of these operators shuffles once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_sample(sample: str = "sample_id", t: str = "t"):
    return Window.partitionBy(sample).orderBy(t)


def frame_index(df: DataFrame, sample: str, *order: str, name: str = "t") -> DataFrame:
    """Adds the frame number of each row: its place, from 0, in its sample's order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(sample).orderBy(*order)) - 1)


def backward_difference(value: str, fps: float, sample: str = "sample_id", t: str = "t") -> Column:
    """Causal velocity: the change since the frame before, per second; zero on the first frame."""
    return F.coalesce((F.col(value) - F.lag(value).over(by_sample(sample, t))) * F.lit(float(fps)), F.lit(0.0))


def forward_difference(value: str, sample: str = "sample_id", t: str = "t") -> Column:
    """Displacement to the next frame; the last frame repeats the one before it, a single frame has zero."""
    w = by_sample(sample, t)
    return F.coalesce(F.lead(value).over(w) - F.col(value), F.col(value) - F.lag(value).over(w), F.lit(0.0))


def integrate(velocity: str, fps: float, sample: str = "sample_id", t: str = "t") -> Column:
    """Running integral of a velocity."""
    return F.sum(F.col(velocity) / F.lit(float(fps))).over(by_sample(sample, t).rowsBetween(Window.unboundedPreceding, 0))


def window_count(n: Column, size: int, stride: int) -> Column:
    """Windows of a sample of n frames: one, and one more for each stride until a window reaches the end."""
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(0), n - size) / stride) + 1).cast("int")


def window_starts(lengths: DataFrame, size: int, stride: int, n: str = "n") -> DataFrame:
    """One row (…, start) for each window. No window starts beyond the end, whatever the stride."""
    count = F.least(window_count(F.col(n), size, stride), F.ceil(F.col(n) / stride).cast("int"))
    return lengths.where(F.col(n) > 0).withColumn("start", F.explode(F.sequence(F.lit(0), (F.greatest(count, F.lit(1)) - 1) * stride, F.lit(stride))))


def sequence_arrays(frames: DataFrame, value: str, sample: str = "sample_id", t: str = "t") -> DataFrame:
    """(sample, values, n): the values of a sample in order of t. One sample has to fit in a row."""
    collected = F.sort_array(F.collect_list(F.struct(t, value)))
    return frames.groupBy(sample).agg(F.transform(collected, lambda r: r[value]).alias("values")).withColumn("n", F.size("values"))


def windowed(sequences: DataFrame, size: int, stride: int, mask: str | None = None) -> DataFrame:
    """(…, start, frames, frame_mask): windows sliced out of `values`; the last frame is repeated where the sample has ended.

    A frame is valid if it is in the sample and, where the sample has a mask, set there.
    """
    slots = F.sequence(F.lit(0), F.lit(size - 1))
    valid = lambda k: F.coalesce(F.get(mask, F.col("start") + k), F.lit(False)) if mask else F.lit(True)
    return (
        window_starts(sequences, size, stride)
        .withColumn("frames", F.transform(slots, lambda k: F.get("values", F.least(F.col("start") + k, F.col("n") - 1))))
        .withColumn("frame_mask", F.transform(slots, lambda k: (F.col("start") + k < F.col("n")) & valid(k)))
    )


def token_masks(mask: str = "frame_mask", group: int = 4) -> tuple[Column, Column]:
    """For each group of frames: all valid (it counts in statistics), any valid (it has a token)."""
    groups = F.sequence(F.lit(0), (F.size(mask) / group).cast("int") - 1)
    part = lambda k: F.slice(mask, k * group + 1, group)
    return F.transform(groups, lambda k: F.forall(part(k.cast("int")), lambda m: m)), F.transform(groups, lambda k: F.exists(part(k.cast("int")), lambda m: m))


def padding(n: Column, multiple: int) -> Column:
    """Frames to add up to a multiple."""
    return F.pmod(-n, F.lit(multiple))


def pad_to_multiple(values: str, multiple: int) -> tuple[Column, Column]:
    """Values with the last one repeated up to a multiple, and the mask of the real ones."""
    more = padding(F.size(values), multiple)
    mask = F.concat(F.array_repeat(F.lit(True), F.size(values)), F.array_repeat(F.lit(False), more))
    return F.concat(values, F.array_repeat(F.element_at(values, -1), more)), mask


def token_groups(frames: DataFrame, sample: str = "sample_id", t: str = "t", group: int = 4) -> DataFrame:
    """(sample, k, frames, complete): tumbling groups by frame count."""
    return frames.groupBy(sample, F.floor(F.col(t) / group).cast("int").alias("k")).agg(F.count("*").alias("frames")).withColumn("complete", F.col("frames") == group)


def gaussian_smooth(value: str, sigma: float, radius: int, sample: str = "sample_id", t: str = "t") -> Column:
    """Gaussian filter with the edge values repeated; weights beyond an edge fall on it.

    The weights of a row's window are known constants; `first` and `last` of the sample take the weight that is left.
    """
    import math

    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = [x / sum(raw) for x in raw]
    w = by_sample(sample, t)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = F.collect_list(value).over(w.rowsBetween(-radius, radius))
    position = F.row_number().over(w)
    before = F.least(position - 1, F.lit(radius))
    table = F.array(*[F.lit(x) for x in weights])
    inner = F.aggregate(F.zip_with(around, F.slice(table, F.lit(radius) - before + 1, F.size(around)), lambda v, g: v * g), F.lit(0.0), lambda a, x: a + x)
    total = F.count(F.lit(1)).over(whole)
    cumulative = [0.0]
    for x in weights:
        cumulative.append(cumulative[-1] + x)
    sums = F.array(*[F.lit(x) for x in cumulative])
    left = F.element_at(sums, (F.lit(radius) - before + 1).cast("int"))
    after = F.least(total - position, F.lit(radius))
    right = F.lit(1.0) - F.element_at(sums, (F.lit(radius) + after + 2).cast("int"))
    return inner + left * F.first(value).over(whole) + right * F.last(value).over(whole)


def frame_bounds(length: str, *order: str, shard: str | None = None) -> tuple[Column, Column]:
    """Half-open bounds of each sequence in the concatenation of its shard."""
    w = (Window.partitionBy(shard) if shard else Window.partitionBy()).orderBy(*order)
    end = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (end - F.col(length)).alias("frame_start"), end.alias("frame_end")
