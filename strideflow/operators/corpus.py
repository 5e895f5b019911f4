"""Corpus assembly: shard packing, offsets, audits, prefix examples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideflow.constants import SHARD_FRAMES
from strideflow.operators.ordering import running_total


def pack_shards(sequences: DataFrame, split: str, order: str, length: str, cap: int = SHARD_FRAMES) -> DataFrame:
    """(split, order, length, shard, frame_start): greedy packing in order. A shard is closed before the cap is passed; a longer sequence has its own.

    Greedy packing is a sequential fold, so a split's lengths stream through one task in order, with three numbers of state; the frames
    themselves do not move. For a split that is too long for that, give a finer `split`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, shard, filled = None, 0, 0
        for batch in batches:
            shards, starts = [], []
            for name, n in zip(batch[split], batch[length], strict=True):
                if name != current:
                    current, shard, filled = name, 0, 0
                if filled and filled + n > cap:
                    shard, filled = shard + 1, 0
                shards.append(shard)
                starts.append(filled)
                filled += n
            yield batch.assign(shard=shards, frame_start=starts)

    rows = sequences.select(split, order, F.col(length).cast("long").alias(length))
    kinds = dict(rows.dtypes)
    ordered = rows.repartition(split).sortWithinPartitions(split, order)
    return ordered.mapInPandas(run, f"{split} {kinds[split]}, {order} {kinds[order]}, {length} bigint, shard bigint, frame_start bigint")


def contiguity_audit(offsets: DataFrame, shard: str, order: str, start: str = "frame_start", end: str = "frame_end") -> DataFrame:
    """(shard, sequences, gaps): places where a sequence does not begin where the one before it ended (the first at zero)."""
    w = Window.partitionBy(shard).orderBy(order)
    gap = F.col(start) != F.coalesce(F.lag(end).over(w), F.lit(0))
    return offsets.withColumn("_gap", gap).groupBy(shard).agg(F.count("*").alias("sequences"), F.count_if("_gap").alias("gaps"))


def corpus_audit(sequences: DataFrame, sample: str, group: str, split: str) -> DataFrame:
    """One row (sequences, duplicate_ids, groups_in_several_splits)."""
    duplicates = sequences.groupBy(sample).agg(F.count("*").alias("c")).agg(F.count("*").alias("distinct_ids"), F.coalesce(F.sum("c"), F.lit(0)).alias("sequences"), F.count_if(F.col("c") > 1).alias("duplicate_ids"))
    leaks = sequences.groupBy(group).agg(F.count_distinct(split).alias("s")).agg(F.count_if(F.col("s") > 1).alias("groups_in_several_splits"))
    return duplicates.crossJoin(leaks)  # one row each


def corpus_summary(sequences: DataFrame, group: list[str], frames: str, has_text: str, fps: float) -> DataFrame:
    """(group, sequences, hours, text_coverage)."""
    return sequences.groupBy(*group).agg(
        F.count("*").alias("sequences"),
        (F.sum(frames) / fps / 3600).alias("hours"),
        F.coalesce(F.try_divide(F.count_if(F.col(has_text)).cast("double"), F.count("*")), F.lit(0.0)).alias("text_coverage"),
    )


def checksum_differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem) of two (path, sha256) tables: missing, unexpected or changed."""
    j = expected.alias("e").join(found.alias("f"), "path", "full_outer")
    problem = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("e.sha256").isNull(), "unexpected").when(F.col("e.sha256") != F.col("f.sha256"), "changed")
    return j.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def token_offsets(lengths: DataFrame, order: str, tokens: str = "tokens") -> DataFrame:
    """Adds offset_start and offset_end, the running sums of tokens in order."""
    return running_total(lengths, order, F.col(tokens), "offset_end").withColumn("offset_start", F.col("offset_end") - F.col(tokens))


def statistics_tokens(frames: str, frames_per_token: int = 4):
    """Tokens that count in statistics: those with all their frames."""
    return F.floor(F.col(frames) / frames_per_token)


def teacher_examples(tokens: DataFrame, sample: str, k: str, human: str, robot: str) -> DataFrame:
    """Each position: human tokens up to it, robot tokens before it, the robot token there."""
    w = Window.partitionBy(sample).orderBy(k)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return tokens.select(sample, k, F.collect_list(human).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("human_prefix"), F.collect_list(robot).over(before).alias("robot_prefix"), F.col(robot).alias("target"))


def student_examples(tokens: DataFrame, sample: str, k: str, human: str, robot: str) -> DataFrame:
    """Each position that has a next one: both prefixes up to it, the next robot token."""
    w = Window.partitionBy(sample).orderBy(k)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = tokens.select(sample, k, F.collect_list(human).over(upto).alias("human_prefix"), F.collect_list(robot).over(upto).alias("robot_prefix"), F.lead(robot).over(w).alias("target"))
    return out.where(F.col("target").isNotNull())


def batches(windows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds batch: consecutive windows, `size` to each."""
    return running_total(windows, order, F.lit(1), "batch").withColumn("batch", F.floor((F.col("batch") - 1) / size).cast("long"))
