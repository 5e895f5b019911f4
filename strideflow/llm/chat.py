"""Relational chat formatting, with Spark expressions only.

The turns of a conversation are collected as structs and sorted by (turn, role, text); adjacent turns of one role are
merged into one block by array functions, and blocks are concatenated. The template is

    <s>[INST]role\\n[/INST]text\\n[SEP]text of the next merged turn\\n</s>

A control string inside a role or a text gets one backslash before it. Every marker that follows a text follows a line
feed, so no marker ever follows a backslash: a control string after a backslash is text, any other is a marker, and
taking one backslash away restores the text. The loss mask covers the texts of assistant turns.

Null text is empty, null role is the empty role, null turn sorts first, rows with equal (turn, role, text) all stay, and
rows of null conv_id make one conversation. Only conv_id, turn, role and text are read. A conversation is one output value, so its
turns have to fit in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"(</?s>|\[/?INST\]|\[SEP\])"
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def collect_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): sorted structs of role and text."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return (
        conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("t"))
        .select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )


def merge_turns(turns: Column) -> Column:
    """Blocks (role, texts) of adjacent turns of one role: the first index of each run, then a slice up to the next one."""
    starts = F.filter(
        F.sequence(F.lit(1), F.size(turns)),
        lambda i: (i == 1) | (F.element_at(turns, i)["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]),
    )

    def block(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), F.size(turns) + 1)
        run = F.slice(turns, start, end - start)
        return F.struct(F.element_at(run, 1)["role"].alias("role"), F.transform(run, lambda t: t["text"]).alias("texts"))

    return F.transform(starts, block)


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, segments): the formatted text, and the same text in segments (text, loss) in order."""
    blocks = collect_turns(conversations).select("conv_id", merge_turns(F.col("turns")).alias("blocks"))

    def segments(block: Column) -> Column:
        head = F.struct(F.concat(F.lit("<s>[INST]"), escape(block["role"]), F.lit("\n[/INST]")).alias("text"), F.lit(False).alias("loss"))
        texts = F.transform(block["texts"], lambda t: F.struct(escape(t).alias("text"), (block["role"] == loss_role).alias("loss")))
        ends = F.transform(
            block["texts"],
            lambda _, k: F.struct(F.when(k + 1 < F.size(block["texts"]), F.lit("\n[SEP]")).otherwise(F.lit("\n</s>")).alias("text"), F.lit(False).alias("loss")),
        )
        return F.concat(F.array(head), F.flatten(F.zip_with(texts, ends, lambda a, b: F.array(a, b))))

    out = blocks.select("conv_id", F.flatten(F.transform("blocks", segments)).alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse_turns(formatted: Column) -> Column:
    """The turns (role, text) in a formatted text: the inverse of the template."""
    blocks = F.filter(F.split(formatted, r"\n</s>", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        parts = F.split(block, r"\n\[/INST\]", 2)
        role = unescape(F.substring(parts[0], F.lit(len("<s>[INST]") + 1), F.length(parts[0])))
        return F.transform(F.split(parts[1], r"\n\[SEP\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from format_chats' output: turns, and the text under the loss mask."""
    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    read = formatted.select("conv_id", "formatted", parse_turns(F.col("formatted")).alias("turns"), F.array_join(masked, "").alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
