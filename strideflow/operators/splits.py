"""Deterministic assignment: hash splits, group priority, leakage audit, sampling and epoch order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideflow.constants import SPLIT_PRIORITY, TRAIN_PERCENT, VAL_PERCENT


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """The first eight bytes of the key's sha256, as a big-endian number, modulo buckets."""
    head = F.conv(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(head, F.lit(buckets).cast("decimal(20,0)")).cast("int")


def stable_split(key: Column) -> Column:
    bucket = hash_bucket(key)
    return F.when(bucket < TRAIN_PERCENT, "train").when(bucket < VAL_PERCENT, "val").otherwise("test")


def split_priority(split: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, k in SPLIT_PRIORITY.items():
        out = out.when(split == name, k)
    return out


def priority_split(priority: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, k in SPLIT_PRIORITY.items():
        out = out.when(priority == k, name)
    return out


def group_split(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """(group, split): the split of the highest priority among a group's members (train, val, test in rising order)."""
    return df.groupBy(group).agg(F.max(split_priority(F.col(split))).alias("p")).select(group, priority_split(F.col("p")).alias("split"))


def resolve_leakage(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Adds group_size, split_before and moves every member of a shared group to the group's split.

    The group's aggregate is joined back: its minima are combined before the shuffle, so a hot group costs one row a task.
    """
    groups = df.groupBy(group).agg(F.count("*").alias("group_size"), F.max(split_priority(F.col(split))).alias("p"))
    return df.join(groups, group).withColumnRenamed(split, "split_before").withColumn(split, priority_split(F.col("p"))).drop("p")


def leakage_audit(df: DataFrame, group: str, split: str, dataset: str) -> DataFrame:
    """One row: groups, shared groups, groups in several splits or datasets, rows that move."""
    target = F.max(split_priority(F.col(split)))
    # rows that move are those of lower splits: counted from counts by split, so the group is never collected
    per = df.groupBy(group).agg(
        F.count("*").alias("n"),
        F.count_distinct(split).alias("splits"),
        F.count_distinct(dataset).alias("datasets"),
        target.alias("p"),
        *[F.count_if(F.col(split) == s).alias(f"n_{s}") for s in SPLIT_PRIORITY],
    )
    kept = sum((F.when(F.col("p") == k, F.col(f"n_{s}")).otherwise(0) for s, k in SPLIT_PRIORITY.items()), F.lit(0))
    return per.agg(
        F.count("*").alias("groups"),
        F.count_if(F.col("n") > 1).alias("shared_groups"),
        F.count_if(F.col("splits") > 1).alias("cross_split_groups"),
        F.count_if(F.col("datasets") > 1).alias("cross_dataset_groups"),
        F.coalesce(F.sum(F.col("n") - kept), F.lit(0)).cast("long").alias("moved_rows"),
    )


def motion_signature(frames: Column, joints: int, places: int = 64) -> Column:
    """sha256 of a motion that does not change when it is moved: of at most `places` evenly spaced frames, each relative to its first joint, in whole millimetres as little-endian 32-bit integers.

    frames: an array of frames, each an array<float> of 3 * joints numbers in metres. Spacing and rounding go to the even neighbour of a half. Differences are of single precision. No frames give null.
    """
    n = F.size(frames)
    count = F.least(n, F.lit(places))
    step = (n - 1).cast("double") / F.greatest(count - 1, F.lit(1))
    at = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.rint(F.when(k == count - 1, (n - 1).cast("double")).otherwise(k * step)).cast("int"))
    axes = F.sequence(F.lit(0), F.lit(3 * joints - 1))

    def word(x: Column) -> Column:
        """Eight hexadecimal digits, the lowest byte first."""
        digits = F.lpad(F.hex(x.cast("long").bitwiseAND((1 << 32) - 1)), 8, "0")
        return F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)])

    def frame(f: Column) -> Column:
        relative = F.transform(axes, lambda k: F.get(f, k).cast("float") - F.get(f, k % 3).cast("float"))
        return F.array_join(F.transform(relative, lambda x: word(F.rint((x * F.lit(1000.0).cast("float")).cast("double")))), "")

    body = F.array_join(F.transform(at, lambda i: frame(F.get(frames, i))), "")
    return F.when(n > 0, F.sha2(F.unhex(body), 256))


def leakage_examples(df: DataFrame, group: str, split: str, dataset: str, key: str, groups: int = 20, members: int = 10) -> DataFrame:
    """(group, members, datasets, final_split) of the first `groups` shared groups by their least key, each with its first `members` keys.

    Bounded whatever a group holds: the groups are a top-k by pre-aggregated minima, and members are limited by rank in each task before the shuffle and again after it.
    """
    shared = df.groupBy(group).agg(F.count("*").alias("_n"), F.min(key).alias("_first"), F.max(split_priority(F.col(split))).alias("_p"), F.collect_set(dataset).alias("_d"))
    top = shared.where("_n > 1").orderBy("_first", group).limit(groups)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(key, dataset))
    few = df.select(group, key, dataset).join(F.broadcast(top), group).withColumn("_k", rank).where(F.col("_k") <= members)
    out = few.groupBy(group).agg(F.sort_array(F.collect_list(key)).alias("members"), F.first("_d").alias("_d"), F.first("_p").alias("_p"))
    return out.select(group, "members", F.sort_array("_d").alias("datasets"), priority_split(F.col("_p")).alias("final_split"))


def hash_order(key: Column, seed: int | str) -> Column:
    """A seeded order that any engine can repeat."""
    return F.sha2(F.concat_ws(":", key.cast("string"), F.lit(str(seed))), 256)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each stratum in hash order. The limit is the feature; partial top-n runs before the shuffle."""
    w = Window.partitionBy(stratum).orderBy(hash_order(F.col(key), seed), key)
    return df.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= n)


def epoch_slice(df: DataFrame, key: str, seed: int, epoch: int, rank: int, world: int) -> DataFrame:
    """The rows of one rank: a seeded order, cut to a multiple of the world size, every world-th row from rank.

    Places come from counts by hash prefix, so no task sorts the whole table.
    """
    placed = dense_place(df.withColumn("_h", hash_order(F.col(key), f"{seed}-{epoch}")), "_h", key)
    total = placed.agg(F.count("*").alias("_n"))
    kept = placed.crossJoin(F.broadcast(total)).where(F.col("place") < F.col("_n") - F.col("_n") % world)  # one row
    return kept.where(F.col("place") % world == rank).drop("_h", "_n")


def dense_place(df: DataFrame, order: str, tie: str) -> DataFrame:
    """Adds place, the rank from 0 in the total order by (order, tie): offsets of 4096 prefixes of the hash, and ranks within one."""
    with_prefix = df.withColumn("_p", F.substring(order, 1, 3))
    counts = with_prefix.groupBy("_p").agg(F.count("*").alias("_c"))
    offsets = counts.withColumn("_o", F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_o", F.lit(0)).alias("_o"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(order, tie)) - 1
    return with_prefix.withColumn("_w", within).join(F.broadcast(offsets), "_p").withColumn("place", F.col("_o") + F.col("_w")).drop("_p", "_o", "_w")


def extremes(df: DataFrame, by: str, key: str, metrics: list[str]) -> DataFrame:
    """(by, metric, low_key, high_key): the row of least and greatest value of each metric, the smaller key on ties."""
    tall = df.select(by, key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m"))
    return tall.groupBy(by, F.col("m.metric").alias("metric")).agg(
        F.min(F.struct(F.col("m.v").alias("v"), F.col(key).alias("k")))["k"].alias("low_key"),
        F.min(F.struct((-F.col("m.v")).alias("v"), F.col(key).alias("k")))["k"].alias("high_key"),
    )
