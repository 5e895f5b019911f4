"""Merkle manifest of a dataset: a 16-ary hash tree for each source, a tree over the sources, and a proof for each row.

H is the lowercase hex SHA-256 of its inputs concatenated, digests as hex text. A leaf is H of the row's fields, each `-` if null, else its
UTF-8 length, `:` and its value. While a tree has several nodes, every 16 consecutive ones (the last run may be shorter, even one) become their H.

Trees are built by an associative, commutative monoid, the sparse forest: unresolved nodes keyed by tree, level and index. How many
siblings a run has is known from the number of leaves of its tree, so merging two forests replaces a run by its parent as soon as its last
sibling is there. Each partition of the ordered leaves gives one forest, and a tree reduction merges `FAN` neighbouring forests in one task
and again what is left of them, until no node is unresolved. A forest over a stretch of leaves keeps at most 15 nodes for each end and level of
the trees that stand across its ends, so no task and never the driver holds more than `FAN` such lists; resolved nodes are written as rows. The
reduction runs as DataFrame rounds over written tables, because RDD.treeReduce would make its last merge in the driver and lose the
resolved nodes, which proofs need.

Leaves are placed by a range sort on (source, doc_id, leaf), so a source that holds most rows spans many partitions, and their numbers are added up
per partition and source. Proofs are made in blocks of 16 ** `BASE` leaves: the runs inside a block are built again from its leaves, and the
runs above it come as one row for each block, so a leaf does not carry its siblings through a shuffle.

A null doc_id or source sorts first. Rows of one source and doc_id are leaves each, by digest. An empty table gives no rows. Columns but those of `FIELDS` take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideflow.llm.storage import materialise, shuffle_partitions, tidy

ARITY = 16
BASE = 2
FAN = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def H(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """The level of the one node that remains of n leaves."""
    level = 0
    while n > 1:
        n, level = -(-n // ARITY), level + 1
    return level


def siblings(n: int, level: int, parent: int) -> int:
    """How many nodes of a level have this parent."""
    return min(ARITY, -(-n // ARITY**level) - ARITY * parent)


class Forest:
    """Unresolved nodes of any number of trees. `made(tree, n, level, index, digest)` is told of each node that a run gives."""

    def __init__(self, made: Callable[[str, int, int, int, str], None] = lambda *node: None):
        self.made, self.runs, self.size = made, {}, {}

    def add(self, tree: str, n: int, level: int, index: int, digest: str) -> None:
        while level < height(n):
            parent, place = divmod(index, ARITY)
            run = self.runs.setdefault((tree, level, parent), {})
            self.size[tree] = n
            run[place] = digest
            if len(run) < siblings(n, level, parent):
                return
            del self.runs[tree, level, parent]
            level, index, digest = level + 1, parent, H(run[k] for k in sorted(run))
            self.made(tree, n, level, index, digest)

    def unresolved(self) -> Iterator[tuple[str, int, int, int, str]]:
        for (tree, level, parent), run in self.runs.items():
            for place, digest in run.items():
                yield tree, self.size[tree], level, ARITY * parent + place, digest

    def merge(self, other: Forest) -> Forest:
        for node in other.unresolved():
            self.add(*node)
        return self


def field(name: str) -> Column:
    value = F.col(name).cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(text: Column | None = None) -> Column:
    """H of a row's fields; text: another text in place of the row's own."""
    body = field("text") if text is None else F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*[field(c) for c in FIELDS[:-1]], body).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf, tampered): the leaf of each row, and where 5 divides the crc32 of doc_id the leaf of its text in lower case.

    tree orders as its source does, null first.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf(F.translate("text", UPPER, LOWER)))
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"), leaf().alias("leaf"), altered.alias("tampered"))


def placed(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """Adds to each row the partition of a range sort by (tree, order), its index within its tree, and the tree's size n. Rows are written in that order."""
    spark = rows.sparkSession
    ranges = rows.repartitionByRange(shuffle_partitions(spark), tree, *order).sortWithinPartitions(tree, *order)
    at = F.monotonically_increasing_id()  # the partition above 33 bits, the place in it below
    ranges = materialise(ranges.withColumn("at", at).select(*rows.columns, F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")), "placed")
    stretches = ranges.groupBy("part", tree).agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy(tree)
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = stretches.select("part", tree, (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    return ranges.join(stretches, ["part", tree]).select(*rows.columns, "part", (F.col("place") + F.col("shift")).alias("index"), "n")


NODE = "part long, open boolean, tree string, n long, level int, index long, digest string"
NODES = pa.schema([("part", pa.int64()), ("open", pa.bool_()), ("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())])


def _forests(least: int, fan: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over nodes by part: one forest for each part // fan. Gives its unresolved nodes, and the nodes that it made at a level of `least` or more, or as a tree's last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, forest = None, Forest()

        def made(tree: str, n: int, level: int, index: int, digest: str) -> None:
            if level >= least or level == height(n):
                out.append((now, False, tree, n, level, index, digest))

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), NODES.types, strict=True)], schema=NODES)
                out.clear()

        for batch in batches:
            for part, *node in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if part // fan != now:
                    out += [(now, True, *x) for x in forest.unresolved()]
                    yield from flush()
                    now, forest = part // fan, Forest(made)
                forest.add(*node)
            yield from flush()
        out += [(now, True, *x) for x in forest.unresolved()]
        yield from flush()

    return tidy(run)


def grow(ordered: DataFrame, least: int) -> DataFrame:
    """(tree, n, level, index, digest) of all nodes at a level of `least` or more and of each tree's last node, from (part, tree, n, index, digest) of leaves."""
    start = ordered.select("part", "tree", "n", F.lit(0).alias("level"), "index", "digest")
    rounds = [materialise(start.mapInArrow(_forests(least, 1), NODE), "forests")]
    columns = ["tree", "n", "level", "index", "digest"]
    nodes = start.where(F.lit(least == 0) | (F.col("n") == 1)).select(*columns)
    while True:
        nodes = nodes.union(rounds[-1].where("NOT open").select(*columns))
        left = rounds[-1].where("open")
        if left.isEmpty():
            return nodes
        near = left.select("part", *columns).repartition(F.floor(F.col("part") / FAN)).sortWithinPartitions("part")
        rounds.append(materialise(near.mapInArrow(_forests(least, FAN), NODE), "forests"))


def levels(n: str) -> Column:
    """height() as an expression, for all sizes that a long can count."""
    return sum((F.when(F.col(n) > ARITY**k, 1).otherwise(0) for k in range(15)), F.lit(0))


def paths(nodes: DataFrame, least: int) -> DataFrame:
    """(tree, n, block, path, top): for each node at level `least` (or a tree's last, if that is lower) the runs from its own up to the tree's last node, each with the node's place in it."""
    nodes = nodes.withColumn("height", levels("n"))
    last = nodes.where("level = height").select("tree", F.col("digest").alias("top"))
    blocks = nodes.where(F.col("level") == F.least(F.lit(least), "height")).select("tree", "n", F.col("index").alias("block"), "height")
    runs = nodes.where((F.col("level") >= least) & (F.col("level") < F.col("height"))).groupBy("tree", "level", F.floor(F.col("index") / ARITY).alias("parent"))
    runs = runs.agg(F.sort_array(F.collect_list(F.struct("index", "digest")))["digest"].alias("run"))
    up = blocks.where(F.col("height") > least).withColumn("level", F.explode(F.sequence(F.lit(least), F.col("height") - 1)))
    own = F.floor(F.col("block") / F.pow(F.lit(ARITY), F.col("level") - least))
    up = up.select("tree", "block", "level", (own % ARITY).alias("place"), F.floor(own / ARITY).alias("parent"))
    path = up.join(runs, ["tree", "level", "parent"]).groupBy("tree", "block").agg(F.sort_array(F.collect_list(F.struct("level", "place", "run"))).alias("path"))
    empty = F.array().cast("array<struct<level:int,place:bigint,run:array<string>>>")
    return blocks.join(path, ["tree", "block"], "left").join(last, "tree").select("tree", "n", "block", F.coalesce("path", empty).alias("path"), "top")


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
PROOFS = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (tree, block)'s rows in order: first the block's own row, with its path, then its leaves by index."""
    block: dict = {}
    own: list[tuple] = []

    def proofs() -> Iterator[pa.RecordBatch]:
        if not own:
            return
        inside = [[d for _, d, _ in own]]
        for _ in range(min(BASE, height(block["n"]))):
            inside.append([H(inside[-1][k : k + ARITY]) for k in range(0, len(inside[-1]), ARITY)])
        above = [(x["run"], x["place"]) for x in block["path"]]
        beside = "".join(d for run, place in above for k, d in enumerate(run) if k != place).encode()
        out = []
        for i, (doc_id, digest, tampered) in enumerate(own):
            steps = [(inside[k][(p := i // ARITY**k) - p % ARITY :][:ARITY], p % ARITY) for k in range(len(inside) - 1)]
            proof, folded = sha256(), tampered or digest
            for run, place in steps:
                proof.update("".join(run[:place] + run[place + 1 :]).encode())
            proof.update(beside)
            for run, place in steps + above:
                folded = H([*run[:place], folded, *run[place + 1 :]])
            out.append((doc_id, digest, block["subroot"], block["root"], proof.hexdigest(), folded, folded == block["root"]))
        own.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), PROOFS.types, strict=True)], schema=PROOFS)

    for batch in batches:
        heads = batch.column("head")
        for k, (index, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("index", "doc_id", "leaf", "tampered")), strict=True)):
            if index < 0:
                yield from proofs()
                block = heads[k].as_py()
            else:
                own.append(tuple(row))
    yield from proofs()


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Four tables: ordered leaves (doc_id, tree, leaf, tampered, part, index, n); nodes of the sources' trees; the sources' places in the tree over them (index, member, digest, n, part); its nodes."""
    ordered = placed(materialise(leaves(docs), "leaves"), "tree", "doc_id", "leaf")
    nodes = materialise(grow(ordered.withColumnRenamed("leaf", "digest"), BASE), "nodes")
    subroots = nodes.where(F.col("level") == levels("n")).select(F.lit("").alias("tree"), F.col("tree").alias("member"), "digest")
    members = placed(subroots, "tree", "member")
    return ordered, nodes, members, materialise(grow(members, 0), "top")


def verify(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    proof_sha256 is H of the siblings on the way from the leaf to the root. folded_root is the root that the leaf and its siblings give, where
    the leaf is that of the tampered text for the rows that `leaves` tampers with.
    """
    ordered, nodes, members, over = manifest(docs)
    top = paths(over, 0).select(F.col("block").alias("index"), F.col("path").alias("more"), F.col("top").alias("root"))
    top = top.join(members.select("index", F.col("member").alias("tree")), "index").drop("index")
    heads = paths(nodes, BASE).join(top, "tree").select("tree", "block", F.lit(-1).cast("long").alias("index"), F.struct("n", F.concat("path", "more").alias("path"), F.col("top").alias("subroot"), "root").alias("head"))
    rows = ordered.select("tree", F.floor(F.col("index") / ARITY**BASE).alias("block"), "index", "doc_id", "leaf", "tampered")
    both = rows.unionByName(heads, allowMissingColumns=True).repartition("tree", "block").sortWithinPartitions("tree", "block", "index")
    return both.select("index", "doc_id", "leaf", "tampered", "head").mapInArrow(tidy(_prove), PROOF)
