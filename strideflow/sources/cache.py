"""Token caches: the tokens of a tokenizer run, kept in versions that are switched as a whole.

    versions/V/tokens       sequence_id, k, token_id
    versions/V/sequences    place, sequence_id, frames, tokens, padding, offset_start, offset_end
    log/N                   one JSON value for each commit: the folder that is current from then on, and its manifest

A write stages a new folder, reads it back and checks it against the contract, and then adds an entry to the log. The entry is one file, which appears by a rename, and is
the only thing that readers go by: whatever fails before it leaves the cache as it was, and a reader sees the old version or the new one.
`rollback` adds an entry that names the version before. Entries are numbered, and a number is taken once; there has to be one writer at a time.

A token stands for four frames at 20 a second. The last group of a sequence may have fewer frames: its token is there, with the frames that were padded
counted, but does not count in codebook statistics. Sequences come in order of place, and offsets are those of their tokens put one after another.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow import constants as C
from strideflow.operators.contracts import cache_problems
from strideflow.operators.ordering import running_total
from strideflow.sources.corpus import BLOCK, Corpus
from strideflow.sources.shared import commit

#: What a manifest states.
FIXED = {"format_version": 2, "input_fps": 20, "frames_per_token": 4, "token_rate_hz": 5, "codebook_size": 256}
DIGESTS = ["tokenizer_sha256", "checkpoint_sha256", "normalizer_sha256", "schema_sha256", "split_sha256"]
#: Tokens of one sequence that are written by one task.
STRETCH = 1 << 20


class CacheError(ValueError):
    pass


def checked(manifest: dict) -> dict:
    """The manifest with its fixed values; other values for them, further fields and digests of another form are refused."""
    whole = FIXED | manifest
    odd = sorted(set(whole) - set(FIXED) - set(DIGESTS)) + [k for k, v in FIXED.items() if whole[k] != v or isinstance(whole[k], bool)]
    odd += [k for k in DIGESTS if not re.fullmatch("[0-9a-f]{64}", str(whole.get(k)))]
    if odd:
        raise CacheError(f"manifest: {', '.join(odd)}")
    return whole


def history(spark: SparkSession, root: str) -> list[dict]:
    """The log's entries, oldest first. One that was not finished has no file yet."""
    try:
        rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(f"{root}/log").collect()  # one row a commit
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return sorted((json.loads(r[0]) for r in rows), key=lambda e: e["number"])


def head(spark: SparkSession, root: str) -> dict | None:
    log = history(spark, root)
    return log[-1] if log else None


def covered(frames: str = "frames") -> Column:
    """Tokens of so many frames."""
    return F.ceil(F.col(frames) / C.FRAMES_PER_TOKEN).cast("long")


def stage(tokens: DataFrame, lengths: DataFrame, at: str) -> None:
    """Writes a version: lengths has sequence_id, place and frames, and states what tokens should hold."""
    rows = lengths.select("place", "sequence_id", F.col("frames").cast("long").alias("frames"), covered().alias("tokens"))
    rows = rows.withColumn("padding", F.col("tokens") * C.FRAMES_PER_TOKEN - F.col("frames"))
    rows = running_total(rows, "place", F.col("tokens"), "offset_end").withColumn("offset_start", F.col("offset_end") - F.col("tokens"))
    rows.select("place", "sequence_id", "frames", "tokens", "padding", "offset_start", "offset_end").write.parquet(f"{at}/sequences")
    tokens.select("sequence_id", "k", F.col("token_id").cast("int").alias("token_id")).repartition("sequence_id", F.floor(F.col("k") / STRETCH)).sortWithinPartitions("sequence_id", "k").write.parquet(f"{at}/tokens")


def _refuse(spark: SparkSession, at: str) -> None:
    found = cache_problems(*(spark.read.parquet(f"{at}/{name}") for name in ("sequences", "tokens"))).groupBy(F.col("problem").alias("reason")).agg(F.count("*").alias("n"), F.min(F.col("sequence_id").cast("string")).alias("first")).collect()  # a row a reason
    if found:
        raise CacheError("; ".join(f"{r.reason}: {r.n} sequences, {r.first} first" for r in sorted(found)))


def write(tokens: DataFrame, lengths: DataFrame, root: str, manifest: dict, replace: bool = False) -> dict:
    """Publishes a version of the cache and returns its log entry. Where one is current already, it is refused unless it is to be replaced."""
    spark, manifest = tokens.sparkSession, checked(manifest)
    now = head(spark, root)
    if now and not replace:
        raise CacheError(f"there is a cache at {root}")
    folder = f"versions/{uuid.uuid4().hex}"
    stage(tokens, lengths, f"{root}/{folder}")
    _refuse(spark, f"{root}/{folder}")
    entry = {"number": now["number"] + 1 if now else 0, "folder": folder, "manifest": manifest}
    commit(spark, f"{root}/log/{entry['number']:012d}", entry)
    return entry


def rollback(spark: SparkSession, root: str) -> dict:
    """Makes the version before the current one current again."""
    log = history(spark, root)
    before = [e for e in log if e["folder"] != log[-1]["folder"]] if log else []
    if not before:
        raise CacheError("there is no version before")
    entry = before[-1] | {"number": log[-1]["number"] + 1}
    commit(spark, f"{root}/log/{entry['number']:012d}", entry)
    return entry


def read(spark: SparkSession, root: str, expected: dict | None = None, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sequences, tokens) of the current version. A manifest other than the expected one is refused, and so is content that breaks the contract."""
    now = head(spark, root)
    if now is None:
        raise CacheError(f"no cache at {root}")
    if expected is not None and now["manifest"] != checked(expected):
        differs = sorted(k for k in now["manifest"] if now["manifest"][k] != checked(expected)[k])
        raise CacheError(f"the cache is of other artefacts: {', '.join(differs)}")
    at = f"{root}/{now['folder']}"
    if check:
        _refuse(spark, at)
    return spark.read.parquet(f"{at}/sequences"), spark.read.parquet(f"{at}/tokens")


def statistics_tokens(sequences: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens with offset, their place in all tokens, and in_statistics: whether all four frames are there."""
    own = sequences.select("sequence_id", "offset_start", F.floor(F.col("frames") / C.FRAMES_PER_TOKEN).alias("whole"))
    return tokens.join(own, "sequence_id").select("sequence_id", "k", "token_id", (F.col("offset_start") + F.col("k")).alias("offset"), (F.col("k") < F.col("whole")).alias("in_statistics"))


def tokenise(corpus: Corpus, split: str, side: str, token: Column, root: str, manifest: dict, replace: bool = False) -> dict:
    """The cache job over a written corpus: token is an expression over `frames`, the up to four frames of a group; the last group's frames are padded with its last one."""
    group = C.FRAMES_PER_TOKEN
    sequences = corpus.sequences(split).withColumn("frames", F.col("frame_end") - F.col("frame_start"))
    held = corpus.blocks().where(F.col("split") == split)  # a block starts with a whole group
    cut = F.transform(F.sequence(F.lit(0), covered("held") - 1), lambda g: F.struct(g.alias("g"), F.slice(side, (g * group + 1).cast("int"), group).alias("frames")))
    groups = held.select("sample_id", "block", F.explode(cut).alias("c")).select(F.col("sample_id").alias("sequence_id"), "block", "c.g", "c.frames")
    short = F.array_repeat(F.element_at("frames", -1), F.lit(group) - F.size("frames"))
    groups = groups.withColumn("frames", F.concat("frames", short)).select("sequence_id", (F.col("block") * (BLOCK // group) + F.col("g")).alias("k"), token.alias("token_id"))
    lengths = sequences.select((F.col("shard") * (1 << 32) + F.col("position")).alias("place"), F.col("sample_id").alias("sequence_id"), "frames")
    return write(groups, lengths, root, manifest, replace)
