"""A corpus of aligned sequences on disk: writer, reader and window scan.

Layout below a root, which has to be new:

    shards/split=S/shard=K   blocks of at most `BLOCK` frames of a sequence: number, sample_id, position, frame_start, block, held and a column of frames for each side. number is
                             the shard; a folder holds shard K and those after it, as many as make up `SHARD_FRAMES` frames at the cap (one, if the cap is that large)
    offsets/split=S          shard, position, frame_start, frame_end of each sequence, half-open in its shard
    sequences/split=S        shard, position, sample_id and the record's other columns
    manifest, texts          accepted, quarantined and split_assignment, and annotations, as JSON lines
    reports                  schema, normalizers, summary, failures_by_reason and source_statistics, as JSON
    checksums                path, length and sha256 of every file above
    committed                one JSON value, written last: a corpus without it cannot be opened

Sequences are packed into shards in the order of sample_id: a shard is closed before it would pass its cap, so no sequence is cut. Shards are sorted into files by
folder, so that a small cap does not make as many files as shards. A sequence longer than the cap is apart from the others of its folder, and in stretches of as many frames as a folder is for,
so it can be several tasks and files. Sums for the normalisers, counts and a digest are
observed on the rows that are written, in the same pass. A writer that dies leaves no marker, and its root has to be removed or another one taken.

A row holds one block, so a sequence of any length is many rows. The window scan numbers the windows of a split from 0, by prefix sums over its sequences. A
window number finds its sequence by merging numbers and first numbers in one order, in buckets of `BUCKET` numbers, without a range join; its blocks are an equi-join, and
only the frames that it needs leave the join.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from strideflow import constants as C
from strideflow.operators import frames as fr
from strideflow.operators.corpus import pack_shards
from strideflow.operators.ordering import running_total
from strideflow.operators.quality import summary as percentiles
from strideflow.sources.shared import commit, committed, materialise
from strideflow.sources.sinks import checksums, content_digest

BLOCK = 256
BUCKET = 65536
MANY_SHARDS = 1000
FORMAT = 2
META = "source_dataset string, source_sequence_id string, source_group_id string, texts array<string>"


def folder_shards(cap: int) -> int:
    """Shards in a folder."""
    return max(1, C.SHARD_FRAMES // cap)


def blocks(frames: DataFrame, sides: list[str]) -> DataFrame:
    """(sample_id, block, held, sides…) of frames (sample_id, t, sides…): runs of at most `BLOCK` frames in order of t, which counts from 0 without gaps."""
    packed = F.sort_array(F.collect_list(F.struct("t", *sides)))
    out = frames.groupBy("sample_id", F.floor(F.col("t") / BLOCK).cast("long").alias("block")).agg(packed.alias("rows"))
    return out.select("sample_id", "block", F.size("rows").alias("held"), *[F.col(f"rows.{s}").alias(s) for s in sides])


def total(column: str, width: int, power: int = 1) -> Column:
    """The sums of a block's frames, channel by channel, of values or of their squares."""
    value = (lambda x: x * x) if power == 2 else (lambda x: x)
    return F.aggregate(column, F.array_repeat(F.lit(0.0), F.lit(width)), lambda s, f: F.zip_with(s, f, lambda a, x: a + value(x.cast("double"))))


def digest(sides: list[str]) -> list[Column]:
    """Two sums over a hash of every block: they tell one content from another whatever the order."""
    own = F.xxhash64("sample_id", "block", *sorted(sides))
    return [F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum(own.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("hash_sum"), F.coalesce(F.bit_xor(own), F.lit(0)).alias("hash_xor")]


def parameters(n: int, sums: list[float], squares: list[float], passthrough: list[int]) -> tuple[list[float], list[float]]:
    """Mean and standard deviation of each channel, the latter at least `STD_FLOOR`; 0 and 1 for channels that pass through."""
    if not n:
        raise ValueError("a normaliser needs train frames")
    mean = [s / n for s in sums]
    std = [max(max(q / n - m * m, 0.0) ** 0.5, C.STD_FLOOR) for q, m in zip(squares, mean, strict=True)]
    return [0.0 if k in passthrough else m for k, m in enumerate(mean)], [1.0 if k in passthrough else s for k, s in enumerate(std)]


def write(records: DataFrame, frames: DataFrame, rejected: DataFrame, root: str, widths: dict[str, int], cap: int = C.SHARD_FRAMES, passthrough: dict[str, list[int]] | None = None, fps: float = C.TARGET_FPS, metrics: list[str] | None = None) -> dict:
    """Writes a corpus and returns what its marker says.

    records: sample_id, split, source_dataset and any further columns, of which texts (an array) are the captions and `metrics` are numbers to report on.
    frames: sample_id, t and an array<float> for each side in widths. rejected: sample_id, source_dataset, reason, detail. A record without frames is rejected
    as `no_frames`, frames without a record are left out. Repeated sample_ids fail, and so does a root that holds a corpus or a part of one.
    """
    spark, sides = records.sparkSession, list(widths)
    lengths = materialise(frames.groupBy("sample_id").agg(F.count("*").alias("frames")), "lengths")
    known = records.join(lengths, "sample_id", "left")
    accepted = materialise(known.where("frames IS NOT NULL"), "accepted")
    lost = known.where("frames IS NULL").select("sample_id", "source_dataset", F.lit("no_frames").alias("reason"), F.lit(None).cast("string").alias("detail"))
    quarantined = materialise(rejected.select("sample_id", "source_dataset", "reason", "detail").unionByName(lost), "quarantined")
    if not accepted.groupBy("sample_id").count().where("count > 1").isEmpty():
        raise ValueError("sample_id has to be unique")

    packed = pack_shards(accepted, "split", "sample_id", "frames", cap)
    place = F.row_number().over(Window.partitionBy("split", "shard").orderBy("frame_start")).cast("long") - 1
    packed = materialise(packed.withColumn("position", place).withColumn("frame_end", F.col("frame_start") + F.col("frames")), "packed")
    packed.select("split", "shard", "position", "frame_start", "frame_end").write.partitionBy("split").parquet(f"{root}/offsets")
    meta = accepted.join(packed.select("sample_id", "shard", "position", "frame_start", "frame_end"), "sample_id").withColumn("fps", F.lit(float(fps)))
    meta.write.partitionBy("split").parquet(f"{root}/sequences")

    rows = blocks(frames.select("sample_id", "t", *sides), sides).join(packed.select("sample_id", "split", F.col("shard").alias("number"), "position", "frame_start", F.when(F.col("frames") > cap, F.col("shard")).alias("alone")), "sample_id")
    many = folder_shards(cap)
    train = F.col("split") == "train"
    rows = rows.withColumns({"shard": F.floor(F.col("number") / many) * many, "stretch": F.floor((F.col("frame_start") + F.col("block") * BLOCK) / (cap * many))})
    rows = rows.repartition("split", "shard", "alone", "stretch").sortWithinPartitions("split", "shard", "number", "frame_start", "block")
    rows = rows.withColumns({f"_{s}{p}": F.when(train, total(s, w, p)) for s, w in widths.items() for p in (1, 2)})
    seen = Observation("corpus")
    sums = [F.sum(F.get(f"_{s}{p}", F.lit(k))).alias(f"{s}_{p}_{k}") for s, w in widths.items() for p in (1, 2) for k in range(w)]
    rows = rows.observe(seen, *digest(sides), F.coalesce(F.sum("held"), F.lit(0)).alias("frames"), F.coalesce(F.sum(F.when(train, F.col("held"))), F.lit(0)).alias("train_frames"), *sums)
    rows.select("number", "sample_id", "position", "frame_start", "block", "held", *sides, "split", "shard").write.partitionBy("split", "shard").parquet(f"{root}/shards")

    got = seen.get
    normalizers = {}
    for s, w in widths.items():
        mean, std = parameters(got["train_frames"], *[[got[f"{s}_{p}_{k}"] for k in range(w)] for p in (1, 2)], (passthrough or {}).get(s, []))
        normalizers[s] = {"mean": mean, "std": std, "source_dataset": "train", "fps": fps, "content_sha256": content_digest(mean, std)}
    manifests(accepted, quarantined, root)
    reports = {"schema": schema(widths, fps), "normalizers": normalizers, **describe(accepted, quarantined, fps, metrics or [])}
    spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in reports.items()], "name string, body string").coalesce(1).write.json(f"{root}/reports")
    checksums(spark, root).write.parquet(f"{root}/checksums")
    marker = {"format": FORMAT, "widths": widths, "cap": cap, "fps": fps, "sequences": reports["summary"]["accepted_sequences"], **{k: got[k] for k in ("blocks", "hash_sum", "hash_xor", "frames", "train_frames")}}
    commit(spark, f"{root}/committed", marker)
    return marker


def manifests(accepted: DataFrame, quarantined: DataFrame, root: str) -> None:
    """JSON lines: what was accepted and what was not, the split of each sequence, and its captions."""
    ordered = accepted.withColumnRenamed("frames", "prepared_frames").orderBy("sample_id")
    ordered.write.json(f"{root}/manifest/accepted")
    quarantined.orderBy("sample_id", "reason").write.json(f"{root}/manifest/quarantined")
    ordered.select("sample_id", "split").write.json(f"{root}/manifest/split_assignment")
    texts = F.coalesce("texts", F.array().cast(accepted.schema["texts"].dataType)) if "texts" in accepted.columns else F.array().cast("array<string>")
    ordered.select("sample_id", texts.alias("texts")).write.json(f"{root}/texts/annotations")


def schema(widths: dict[str, int], fps: float) -> dict:
    """The representation contract of a corpus: types, shapes and rate of each side, and how ranges and normalisers are meant."""
    sides = {s: {"dtype": "float32", "shape": f"[T,{w}]"} for s, w in widths.items()}
    return {"schema_version": 1, "target_fps": fps, "frame_ranges": "half-open [frame_start,frame_end)", "normalizer_fit_split": "train", **sides}


def describe(accepted: DataFrame, quarantined: DataFrame, fps: float, metrics: list[str]) -> dict:
    """summary, failures_by_reason and source_statistics: counts by data set, split and reason, each a few rows."""
    captioned = F.coalesce(F.size("texts") > 0, F.lit(False)) if "texts" in accepted.columns else F.lit(False)
    cells = accepted.groupBy("source_dataset", "split").agg(F.count("*").alias("n"), F.sum("frames").alias("frames"), F.count_if(captioned).alias("captioned")).collect()
    failed = quarantined.groupBy("source_dataset", "reason").agg(F.count("*").alias("n")).collect()

    def by(rows: list, key: str, value: str = "n") -> dict:
        out: dict = {}
        for r in rows:
            name = "unknown" if r[key] is None else r[key]
            out[name] = out.get(name, 0) + r[value]
        return dict(sorted(out.items()))

    n, spoken = sum(r.n for r in cells), sum(r.captioned for r in cells)
    hours = {k: v / fps / 3600 for k, v in by(cells, "source_dataset", "frames").items()}
    found: dict = {}
    for r in percentiles(accepted, ["source_dataset"], metrics).collect() if metrics else []:
        found.setdefault(r.source_dataset, {})[r.metric] = {"min": r.minimum, "median": r.median, "p95": r.p95, "max": r.maximum}
    sources = {
        name: {"accepted": count, "accepted_duration_hours": hours[name], "quarantined": by(failed, "source_dataset").get(name, 0), "failures_by_reason": by([r for r in failed if r.source_dataset == name], "reason"), "quality_metrics": found.get(name, {})}
        for name, count in by(cells, "source_dataset").items()
    }
    summary = {
        "accepted_sequences": n, "quarantined_sequences": sum(r.n for r in failed), "accepted_duration_hours": sum(r.frames for r in cells) / fps / 3600, "by_dataset": by(cells, "source_dataset"),
        "by_split": by(cells, "split"), "captioned_sequences": spoken, "text_coverage": spoken / n if n else 0.0, "target_fps": fps,
    }
    return {"summary": summary, "failures_by_reason": by(failed, "reason"), "source_statistics": sources}


class Corpus:
    """A committed corpus. Opening one that was not finished raises."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.marker = committed(spark, f"{root}/committed")
        if self.marker is None:
            raise ValueError(f"no committed corpus at {root}")
        if self.marker["format"] != FORMAT:
            raise ValueError(f"the corpus at {root} has format {self.marker['format']}, not {FORMAT}")

    def blocks(self) -> DataFrame:
        """The written blocks, with split, shard and folder, the first shard of the folder that they are in."""
        held = self.spark.read.parquet(f"{self.root}/shards")
        return held.withColumnRenamed("shard", "folder").withColumnRenamed("number", "shard")

    def report(self, name: str) -> dict:
        return json.loads(self.spark.read.json(f"{self.root}/reports").where(F.col("name") == name).first().body)

    def differences(self) -> list[str]:
        """What the written blocks have that the marker does not say, by name."""
        found = self.blocks().agg(*digest(list(self.marker["widths"])), F.coalesce(F.sum("held"), F.lit(0)).alias("frames")).first().asDict()
        return [k for k, v in found.items() if self.marker[k] != v]

    def sequences(self, split: str) -> DataFrame:
        """Metadata and offsets of a split's sequences, put together by their places in the shard. A place that only one side has fails the read."""
        side = lambda name: self.spark.read.parquet(f"{self.root}/{name}").where(F.col("split") == split)
        meta = side("sequences").select("shard", "position", "sample_id", F.lit(True).alias("_m"))
        both = meta.join(side("offsets").select("shard", "position", "frame_start", "frame_end", F.lit(True).alias("_o")), ["shard", "position"], "full_outer")
        whole = F.col("_m").isNotNull() & F.col("_o").isNotNull() & (F.col("frame_end") > F.col("frame_start"))
        strict = F.when(whole, F.col("sample_id")).otherwise(F.raise_error(F.concat(F.lit("offsets do not fit the sequences of shard "), F.col("shard").cast("string"))))
        return both.select("shard", "position", strict.alias("sample_id"), "frame_start", "frame_end")

    def index(self, split: str, size: int, stride: int) -> DataFrame:
        """(shard, position, sample_id, frame_start, n, first, windows): the numbers of a sequence's windows are first to first + windows - 1."""
        n = F.col("frame_end") - F.col("frame_start")
        rows = self.sequences(split).withColumns({"n": n, "windows": fr.window_count(n, size, stride).cast("long"), "ordinal": F.col("shard") * (1 << 32) + F.col("position")})
        rows = running_total(rows, "ordinal", F.col("windows"), "first")
        return rows.select("shard", "position", "sample_id", "frame_start", "n", (F.col("first") - F.col("windows")).alias("first"), "windows")

    def locate(self, numbers: DataFrame, split: str, size: int, stride: int) -> DataFrame:
        """(number, window, shard, position, sample_id, n, start, reason) for each distinct number; a negative one counts from the end.

        A number outside the split has reason `index`. A stride longer than the window can number a window that would begin beyond the end: it has reason `empty`.
        """
        index = materialise(self.index(split, size, stride), "window-index")
        count = index.agg(F.max(F.col("first") + F.col("windows"))).first()[0]
        if not count:
            raise ValueError(f"empty corpus split: {split}")
        wanted = numbers.select(F.col(numbers.columns[0]).cast("long").alias("number")).distinct()
        wanted = wanted.withColumn("window", F.when(F.col("number") < 0, F.col("number") + count).otherwise(F.col("number")))
        inside = (F.col("window") >= 0) & (F.col("window") < count)
        # a sequence stands at the head of every bucket that its numbers reach into
        heads = index.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / BUCKET), F.floor((F.col("first") + F.col("windows") - 1) / BUCKET))))
        heads = heads.select("bucket", F.greatest("first", F.col("bucket") * BUCKET).alias("window"), F.lit(0).alias("asks"), F.struct("shard", "position", "sample_id", "n", "first").alias("s"))
        asks = wanted.where(inside).select(F.floor(F.col("window") / BUCKET).alias("bucket"), "window", F.lit(1).alias("asks"), "number")
        order = Window.partitionBy("bucket").orderBy("window", "asks").rowsBetween(Window.unboundedPreceding, 0)
        merged = heads.unionByName(asks, allowMissingColumns=True).withColumn("s", F.last("s", ignorenulls=True).over(order)).where("asks = 1")
        found = merged.select("number", "window", "s.shard", "s.position", "s.sample_id", "s.n", ((F.col("window") - F.col("s.first")) * stride).alias("start"))
        found = found.withColumn("reason", F.when(F.col("start") >= F.col("n"), "empty"))
        return found.unionByName(wanted.where(~inside).select("number", F.lit("index").alias("reason")), allowMissingColumns=True)

    def windows(self, numbers: DataFrame, split: str, side: str, size: int = C.WINDOW_FRAMES, stride: int = C.WINDOW_STRIDE, normalizer: dict | None = None) -> DataFrame:
        """(number, sample_id, start, frames, frame_mask, token_mask, reason) of windows by number.

        Frames are normalised first, and then the last one is repeated where the sequence has ended; a token counts if all its frames are in the sequence.
        """
        if stride <= 0 or size <= 0 or size % C.FRAMES_PER_TOKEN:
            raise ValueError("size has to be whole tokens and stride positive")
        found = materialise(self.locate(numbers, split, size, stride), "windows")
        held = self.blocks().where(F.col("split") == split)
        shards = [r[0] for r in found.where("reason IS NULL").select("shard").distinct().limit(MANY_SHARDS + 1).collect()]
        if len(shards) <= MANY_SHARDS:  # a filter that reaches the scan; with more, nearly all are read anyway
            many = folder_shards(self.marker["cap"])
            held = held.where(F.col("folder").isin(sorted({k // many * many for k in shards})) & F.col("shard").isin(shards))
        stop = F.least(F.col("start") + size, F.col("n"))
        parts = found.where("reason IS NULL").withColumn("stop", stop).withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("stop") - 1) / BLOCK))))
        held = held.select(F.col("shard").cast("long").alias("shard"), "position", "block", side)
        met = parts.join(held, ["shard", "position", "block"])
        low = F.greatest(F.col("start") - F.col("block") * BLOCK, F.lit(0))
        high = F.least(F.col("stop") - F.col("block") * BLOCK, F.lit(BLOCK))
        met = met.select("number", "sample_id", "start", "block", F.slice(side, (low + 1).cast("int"), (high - low).cast("int")).alias("part"))
        whole = F.flatten(F.sort_array(F.collect_list(F.struct("block", "part")))["part"])
        rows = met.groupBy("number", "sample_id", "start").agg(whole.alias("frames"))
        if normalizer:
            mean, std = (F.array(*[F.lit(float(x)) for x in normalizer[k]]) for k in ("mean", "std"))
            rows = rows.withColumn("frames", F.transform("frames", lambda f: F.zip_with(F.zip_with(f, mean, lambda x, m: x.cast("double") - m), std, lambda x, s: (x / s).cast("float"))))
        kept = F.size("frames")
        mask = F.concat(F.array_repeat(F.lit(True), kept), F.array_repeat(F.lit(False), F.lit(size) - kept))
        padded = F.concat("frames", F.array_repeat(F.element_at("frames", -1), F.lit(size) - kept))
        rows = rows.select("number", "sample_id", "start", padded.alias("frames"), mask.alias("frame_mask"))
        rows = rows.withColumn("token_mask", fr.token_masks(group=C.FRAMES_PER_TOKEN)[0])
        return rows.withColumn("reason", F.lit(None).cast("string")).unionByName(found.where("reason IS NOT NULL").select("number", "sample_id", "start", "reason"), allowMissingColumns=True)
