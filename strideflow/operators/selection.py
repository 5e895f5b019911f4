"""Exact percentiles of groups of any size, by distributed selection.

A percentile needs one or two values by rank. Each wanted rank of each group has a range of values that holds it. In each round, the rows within the ranges are counted in `BINS`
bins of their range, counts are combined before the shuffle, and the bin that holds the rank, with the least and greatest value in it, is the next range. Rounds cut the range evenly
by value and by logarithm in turn, so values that span many powers of ten narrow as well. Once no range holds more than `LEAF` different rows, or a range is one value, only the rows within the
ranges are sorted. No aggregate and no task holds a group's values. Null values do not count; NaN counts as greater than all others, as it sorts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideflow.sources.shared import materialise

BINS = 1024
LEAF = 65536


def scaled(value: Column, by_log: bool) -> Column:
    """A function of the value that never falls where the value rises, and is finite."""
    largest = F.lit(1.7e308)
    held = F.when(F.isnan(value), largest).otherwise(F.greatest(-largest, F.least(largest, value)))
    # halved, so that the difference of two is finite
    return F.signum(held) * F.log1p(F.abs(held) * F.lit(1e18)) if by_log else held / 2


def percentiles(df: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """(group…, n, minimum, maximum, p0, p1, …): counts, extremes and percentiles with linear interpolation, in the order of shares. Groups of nulls alone are left out.

    Runs jobs while it is called: df is written once to the shared folder, and each round scans the group and value columns.
    """
    rows = materialise(df.select(*group, F.col(value).cast("double").alias("v")).where("v IS NOT NULL"), "selection")
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"), F.min("v").alias("minimum"), F.max("v").alias("maximum"))
    sizes = materialise(sizes, "sizes")
    place = lambda s: F.lit(float(s)) * (F.col("n") - 1)
    wanted = F.array_distinct(F.concat(*[F.array(F.floor(place(s)), F.ceil(place(s))) for s in shares]))
    ranges = sizes.select(*group, F.explode(wanted).alias("rank"), F.col("minimum").alias("low"), F.col("maximum").alias("high"), F.lit(0).cast("long").alias("below"), F.col("n").alias("held"))
    match = lambda a, b: [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in group]

    def within(ranges: DataFrame) -> DataFrame:
        """The rows of each range that is not one value yet."""
        on = [*match("r", "w"), F.col("r.v") >= F.col("w.low"), F.col("r.v") <= F.col("w.high"), F.col("w.low") < F.col("w.high")]
        joined = rows.alias("r").join(ranges.alias("w"), on)
        return joined.select(*[F.col(f"w.{g}").alias(g) for g in group], "w.rank", "w.low", "w.high", "w.below", "r.v")

    turn = 0
    while not ranges.where((F.col("held") > LEAF) & (F.col("low") < F.col("high"))).isEmpty():
        s = lambda c, by_log=turn % 2 == 1: scaled(F.col(c), by_log)
        share = (s("v") - s("low")) / (s("high") - s("low"))
        bin_ = F.least(F.lit(BINS - 1), F.floor(F.coalesce(F.when(s("high") > s("low"), share), F.lit(0.0)) * BINS)).cast("int")
        counts = within(ranges).groupBy(*group, "rank", "below", bin_.alias("bin")).agg(F.count("*").alias("held"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("held").over(Window.partitionBy(*group, "rank").orderBy("bin"))
        found = counts.withColumn("upto", F.col("below") + upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("held") <= F.col("rank")))
        narrowed = found.select(*group, "rank", "low", "high", (F.col("upto") - F.col("held")).alias("below"), "held")
        ranges = materialise(ranges.where(F.col("low") >= F.col("high")).unionByName(narrowed), "ranges")
        turn += 1
    order = F.row_number().over(Window.partitionBy(*group, "rank").orderBy("v")) - 1
    last = within(ranges).withColumn("at", F.col("below") + order).where(F.col("at") == F.col("rank")).select(*group, "rank", "v")
    exact = ranges.where(F.col("low") >= F.col("high")).select(*group, "rank", F.col("low").alias("v")).unionByName(last)
    values = exact.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("values"))  # two a share at most
    out = sizes.alias("s").join(values.alias("t"), match("s", "t")).select(*[F.col(f"s.{g}").alias(g) for g in group], "s.n", "s.minimum", "s.maximum", "t.values")

    def value_of(s: float) -> Column:
        low, high = (F.col("values")[f(place(s))] for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (high - low) * (place(s) - F.floor(place(s))))

    return out.select(*group, "n", "minimum", "maximum", *[value_of(s).alias(f"p{k}") for k, s in enumerate(shares)])
