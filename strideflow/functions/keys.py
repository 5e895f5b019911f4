"""String keys: canonical source keys, person keys, caption rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compact(s: Column) -> Column:
    """Lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def _folder(path: Column) -> Column:
    """The folders above a path's last part, each compacted."""
    return F.regexp_replace(F.lower(F.regexp_replace(path, "/?[^/]*$", "")), "[^a-z0-9/]", "")


def canonical_motion_key(path: Column, prefix: str = "pose_data/") -> tuple[Column, Column]:
    """(folder, name) of a motion file's path: slashes forward, a leading "./" and the prefix dropped once, every part compacted."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")
    p = F.regexp_replace(p, f"^{prefix}", "")
    return _folder(p), compact(F.regexp_replace(F.regexp_extract(p, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))


def track_key(path: Column) -> tuple[Column, Column, Column]:
    """(folder, name, fps) of a track file's path below its root, `<name>_<fps>_jpos.<ext>`; all null for other names."""
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    named = stem.rlike("^.+_[0-9]+_jpos$")
    own = "^(.+)_([0-9]+)_jpos$"
    return F.when(named, _folder(path)), F.when(named, compact(F.regexp_extract(stem, own, 1))), F.when(named, F.regexp_extract(stem, own, 2).cast("int"))


def person_key(name: Column) -> tuple[Column, Column]:
    """(base, person): what stands before and after the last "_P"; empty where there is none."""
    return F.regexp_extract(name, "^(.*)_P([^_]*)$", 1), F.regexp_extract(name, "^(.*)_P([^_]*)$", 2)


def mirror_group(name: Column) -> Column:
    """The group of a sequence and its mirror image."""
    return F.regexp_replace(name, "_M$", "")


def unpivot_captions(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, source_field, text) for each caption column, trimmed, blanks dropped."""
    tall = df.unpivot([key], columns, "source_field", "text").withColumn("text", F.trim("text"))
    return tall.where(F.length("text") > 0)


CAPTION = "array<struct<text:string,kind:string,source_field:string,start_t:double,end_t:double,problem:string>>"


def captions(labels: Column, kind: str, field: str) -> Column:
    """A JSON list of labels as caption structs. A label is a string, or an object whose `proc_label` is the text and whose start_t and end_t, where there, are its times in seconds.

    Texts are trimmed and blank ones left out; so are labels of any other type, null and a text that is not a JSON list. A time that is no number is null, with the problem `start_t` or `end_t`.
    """
    items = F.coalesce(F.try_variant_get(F.try_parse_json(labels), "$", "array<variant>"), F.array().cast("array<variant>"))
    time = lambda v, key: F.try_variant_get(v, f"$.{key}", "double")
    bad = lambda v, key: F.when(F.coalesce(F.try_variant_get(v, f"$.{key}", "string").isNotNull(), F.lit(False)) & time(v, key).isNull(), key)

    def caption(v: Column) -> Column:
        plain = F.schema_of_variant(v) == "STRING"
        text = F.trim(F.when(plain, F.try_variant_get(v, "$", "string")).when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$.proc_label", "string")))
        start, end = (F.when(~plain, time(v, k)) for k in ("start_t", "end_t"))
        return F.struct(text.alias("text"), F.lit(kind).alias("kind"), F.lit(field).alias("source_field"), start.alias("start_t"), end.alias("end_t"), F.when(~plain, F.coalesce(bad(v, "start_t"), bad(v, "end_t"))).alias("problem"))

    return F.filter(F.transform(items, caption), lambda c: F.length(c["text"]) > 0)
