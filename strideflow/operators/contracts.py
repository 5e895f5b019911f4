"""Contracts as columns: each gives the first rule that a row breaks, or null. Nothing is shuffled; quality.route splits rows by them.

A null or empty input breaks the rule on shape. Reasons are names of this library, in the order in which the rules are tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideflow import constants as C


def first_of(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that is broken; a rule that gives null counts as broken."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(True)), name) for broken, name in rules], F.lit(None).cast("string"))


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def sequence_reason(values: Column, width: int, mask: Column | None = None, multiple: int = 1) -> Column:
    """A flat sequence: whole frames of a width, at least one, as many as a multiple, finite; a mask of as many flags, one of them set at least."""
    n = F.size(values) / width
    rules = [(F.size(values) <= 0, "shape"), (F.size(values) % width != 0, "width"), (n % multiple != 0, "alignment"), (F.exists(values, lambda x: ~finite(x)), "finite")]
    if mask is not None:
        rules += [(F.size(mask) != n, "mask_shape"), (F.exists(mask, lambda m: m.isNull()) | ~F.exists(mask, lambda m: m), "mask_empty")]
    return first_of(*rules)


def reconstruction_reason(target: Column, prediction: Column, mask: Column, width: int) -> Column:
    """Both sides of an evaluation have one shape, and both are sequences under the mask."""
    both = F.coalesce(sequence_reason(target, width, mask), sequence_reason(prediction, width, mask))
    return F.coalesce(F.when(F.coalesce(F.size(target) != F.size(prediction), F.lit(True)), "shape"), both)


def timeline_reason(timestamps: Column, at_least: int = 1) -> Column:
    """Finite, strictly increasing times."""
    n = F.size(timestamps)
    falls = F.exists(F.zip_with(F.slice(timestamps, 1, F.greatest(n - 1, F.lit(0))), F.slice(timestamps, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b <= a), lambda x: x)
    return first_of((n < at_least, "length"), (F.exists(timestamps, lambda x: ~finite(x)), "finite"), ((n > 1) & falls, "order"))


def window_reason(frames: Column, stride: Column) -> Column:
    """Windows of whole tokens."""
    return first_of((F.least(frames, stride) <= 0, "dimension"), ((frames % C.FRAMES_PER_TOKEN != 0) | (stride % C.FRAMES_PER_TOKEN != 0), "alignment"))


def tokenizer_reason(kind: Column, fps: Column, frames_per_token: Column, codes: Column, expected_kind: str) -> Column:
    """The tokenizer that language examples are made with."""
    timing = (F.abs(fps - C.TARGET_FPS) > 1e-9 * F.greatest(F.abs(fps), F.lit(C.TARGET_FPS))) | (frames_per_token != C.FRAMES_PER_TOKEN)
    return first_of((kind != expected_kind, "domain"), (timing, "timing"), (codes != C.CODEBOOK_SIZE, "codebook"))


def architecture_reason(width: Column, code_dim: Column, depth: Column, codes: Column, decay: Column, max_depth: int) -> Column:
    return first_of(
        (F.least(width, code_dim, depth) <= 0, "dimension"), (depth > max_depth, "depth"), (codes != C.CODEBOOK_SIZE, "codebook"), (~((decay >= 0) & (decay < 1)) | F.isnan(decay), "decay")
    )


def contact_threshold_reason(height: Column, speed: Column) -> Column:
    return first_of((~finite(height) | ~finite(speed) | (height <= 0) | (speed <= 0), "threshold"))


def only_name(names: Column) -> Column:
    """The one string of an array; null unless there is just one."""
    return F.when(F.size(names) == 1, F.get(names, F.lit(0)))


def cover_reason(frames: Column, tokens: Column, padding: Column) -> Column:
    """Tokens and padding cover the frames of a cached sequence exactly."""
    return first_of((frames <= 0, "frames"), (tokens != F.ceil(frames / C.FRAMES_PER_TOKEN), "tokens"), (padding != tokens * C.FRAMES_PER_TOKEN - frames, "padding"))


def cache_problems(sequences: DataFrame, tokens: DataFrame) -> DataFrame:
    """(sequence_id, problem) of a token cache: sequences (sequence_id, frames, tokens, padding) and tokens (sequence_id, k, token_id).

    One row for each sequence that is repeated, blank, not covered, without its tokens or with tokens outside the codebook; and for tokens of no sequence.
    """
    stated = sequences.groupBy("sequence_id").agg(F.count("*").alias("times"), F.min(F.struct("frames", "tokens", "padding")).alias("s"))
    k = F.col("k")
    held = tokens.groupBy("sequence_id").agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("token_id").between(0, C.CODEBOOK_SIZE - 1), F.lit(False))).alias("outside"), F.min(k).alias("first"), F.max(k).alias("last"), F.count_distinct(k).alias("places")
    )
    j = stated.alias("a").join(held.alias("b"), F.col("a.sequence_id").eqNullSafe(F.col("b.sequence_id")), "full_outer")
    n = F.coalesce("n", F.lit(0))
    problem = F.coalesce(
        F.when(F.col("times").isNull(), "unknown_sequence"), F.when(F.coalesce(F.col("a.sequence_id").cast("string") == "", F.lit(True)), "blank_id"), F.when(F.col("times") > 1, "repeated_id"),
        cover_reason(F.col("s.frames"), F.col("s.tokens"), F.col("s.padding")), F.when(n != F.col("s.tokens"), "length"), F.when(F.col("outside") > 0, "token_range"),
        F.when((n > 0) & ((F.col("first") != 0) | (F.col("last") != n - 1) | (F.col("places") != n)), "position"),
    )
    return j.select(F.coalesce("a.sequence_id", "b.sequence_id").alias("sequence_id"), problem.alias("problem")).where("problem IS NOT NULL")


def bounded_choice(rows: DataFrame, stratum: str, order: str, duration: str, low: float, high: float, count: int, seed: int) -> DataFrame:
    """`count` rows of each stratum whose duration is in the bounds, by a hash of (seed, order); a stratum with fewer fails the query."""
    inside = rows.where(F.col(duration).between(low, high))
    sizes = inside.groupBy(stratum).agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), order), order))
    chosen = inside.withColumn("_k", place).where(F.col("_k") <= count).join(sizes, stratum)
    return chosen.where(F.when(F.col("_n") < count, F.raise_error(F.lit("too few rows in a stratum")).cast("boolean")).otherwise(F.lit(True))).drop("_k", "_n")
