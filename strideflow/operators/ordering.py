"""Running totals and places in a total order without a window over one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOUNDS = 256


def running_total(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """Adds name: the sum of value over all rows up to this one in the order of a column without repeated values.

    Rows are dealt to ranges between at most `BOUNDS` values of the order column, drawn by hash, which decide speed alone. Each range has its
    own running sum, and the sums of the ranges before it, one row for each range, are broadcast.
    """
    bounds = sorted(r[0] for r in df.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(BOUNDS).collect())
    literals = F.array(*map(F.lit, bounds)) if bounds else None
    part = F.coalesce(F.size(F.filter(literals, lambda b: b < F.col(order))), F.lit(0)) if bounds else F.lit(0)
    rows = df.withColumns({"_part": part, "_value": value})
    totals = rows.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    own = F.sum("_value").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_value", "_own", "_before")
