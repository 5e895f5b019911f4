"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.llm.storage import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node reaches, for nodes of edges (a, b); a node that is its own root has no row.

    Alternates large-star (greater neighbours go to the smallest neighbour) and small-star (lesser neighbours and the node
    itself go to the smallest) until nothing changes. Each round is written to the shared folder, so its lineage is short and a
    lost executor costs one round at most. Minima are pre-aggregated before each shuffle and a hub's edges are an equi-join,
    which adaptive execution splits.
    """
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _state(e)
    while seen[0]:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        # every u keeps its smallest neighbour, and its other neighbours are sent to that one
        moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _state(e)
        if now == seen:
            break
        seen = now
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def _state(e: DataFrame) -> tuple:
    """Tells one edge set from another: their number and two sums over hashes."""
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.hash("v", "u").cast("long"))).first()
    return tuple(r)
