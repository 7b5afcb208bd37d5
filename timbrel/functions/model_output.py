"""Texts that a model returns, read as JSON: fences stripped, defaults filled in, fields checked, faults named instead of raised."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def unfenced(raw: Column) -> Column:
    """The text within a code fence, without its ``json`` mark; a text without a fence as it is, stripped."""
    text = stripped(raw)
    bare = stripped(F.btrim(text, F.lit("`")))
    bare = F.when(F.lower(F.left(bare, F.lit(4))) == "json", stripped(F.substr(bare, F.lit(5)))).otherwise(bare)
    return F.when(text.startswith("```"), bare).otherwise(text)


@dataclass(frozen=True)
class Field:
    """A field of a record: its type, whether it must be there, what stands for it otherwise, and the numbers it may have."""

    kind: str  # string, double, bigint or boolean
    default: object = None
    required: bool = False
    low: float | None = None
    high: float | None = None
    above: float | None = None


# What a clip of a plan has, and the ranges of its numbers.
CLIP = {
    "title": Field("string", required=True), "hook": Field("string", required=True), "start_sec": Field("double", required=True, low=0), "end_sec": Field("double", required=True, above=0),
    "duration_sec": Field("double", required=True, above=0), "confidence": Field("double", required=True, low=0, high=1), "why_it_works": Field("string", required=True),
    "add_broll": Field("boolean", required=True), "broll_query": Field("string", required=True), "editorial_score": Field("double", 0.0, low=0, high=1),
    "start_segment_index": Field("bigint", -1, low=-1), "end_segment_index": Field("bigint", -1, low=-1), "visual_mode": Field("string", "alternate_scenic"),
}


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _typed(v: Column, f: Field) -> Column:
    """The value in its type: a string must be one, numbers and truth values may be written as strings."""
    got = F.try_variant_get(v, "$", f.kind)
    return F.when(_kind(v) == "STRING", got) if f.kind == "string" else F.when(~_kind(v).rlike("^(OBJECT|ARRAY)"), got)


def record(v: Column, fields: Mapping[str, Field]) -> tuple[Column, Column]:
    """(struct of the fields, array of faults) of a variant that should be an object."""
    values, faults = [], [F.when(~_kind(v).startswith("OBJECT"), F.lit("not an object"))]
    for name, f in fields.items():
        at = F.try_variant_get(v, f"$.{name}", "variant")
        there = at.isNotNull()
        value = F.when(there, _typed(at, f)).otherwise(F.lit(f.default).cast(f.kind))
        values.append(value.alias(name))
        if f.required:
            faults.append(F.when(~there, F.lit(f"{name}: missing")))
        faults.append(F.when(there & _typed(at, f).isNull(), F.lit(f"{name}: not {f.kind}")))
        for ok, what in ((value >= f.low if f.low is not None else None, f"at least {f.low}"), (value <= f.high if f.high is not None else None, f"at most {f.high}"), (value > f.above if f.above is not None else None, f"above {f.above}")):
            if ok is not None:
                faults.append(F.when(~ok, F.lit(f"{name}: not {what}")))
    return F.struct(*values), F.filter(F.array(*faults), lambda x: x.isNotNull())


def clip_plans(rows: DataFrame, keys: list[str], raw: str = "raw", stem: str = "stem", language: str = "Arabic", fields: Mapping[str, Field] = CLIP) -> DataFrame:
    """keys, source_stem, language, clips (array of structs), error: each row's plan, or why there is none.

    What is JSON but no object gives an empty plan; a missing stem or language and clips that are no
    list are made up for. One faulty clip makes a plan an error, as its numbers can't be trusted.
    """
    df = rows.select(*keys, F.col(stem).alias("_stem"), stripped(F.col(raw)).alias("_raw"))
    df = df.withColumn("_v", F.try_parse_json("_raw"))
    object_ = _kind(F.col("_v")).startswith("OBJECT")
    listed = F.coalesce(F.when(object_, F.try_variant_get("_v", "$.clips", "array<variant>")), F.array().cast("array<variant>"))
    # a row for each clip, so that fields are worked out as columns
    one = df.select(*keys, "_stem", "_raw", "_v", F.posexplode_outer(listed).alias("_at", "_clip"))
    value, faults = record(F.col("_clip"), fields)
    one = one.select(*keys, "_stem", "_v", "_at", F.when(F.col("_at").isNotNull(), value).alias("_value"), F.when(F.col("_at").isNotNull(), faults).alias("_faults"))
    got = one.groupBy(*keys).agg(
        F.first("_stem").alias("_stem"), F.first("_v").alias("_v"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", F.col("_value").alias("v"))))), lambda x: x["v"]).alias("clips"),
        F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.size("_faults") > 0, F.struct("_at", "_faults")))), lambda x: F.transform(x["_faults"], lambda y: F.concat(F.lit("clip "), (x["_at"] + 1).cast("string"), F.lit(": "), y)))), "; ").alias("_bad"),
    )
    is_object = _kind(F.col("_v")).startswith("OBJECT")
    text = lambda name, other: F.when(F.try_variant_get("_v", f"$.{name}", "variant").isNull() | ~is_object, other).otherwise(F.when(_kind(F.try_variant_get("_v", f"$.{name}", "variant")) == "STRING", F.try_variant_get("_v", f"$.{name}", "string")))
    source, spoken = text("source_stem", F.col("_stem")), text("language", F.lit(language))
    error = F.when(F.col("_v").isNull(), "not JSON").when(source.isNull(), "source_stem: not string").when(spoken.isNull(), "language: not string").when(F.col("_bad") != "", F.col("_bad"))
    return got.select(*keys, F.when(error.isNull(), source).alias("source_stem"), F.when(error.isNull(), spoken).alias("language"), F.when(error.isNull(), F.col("clips")).alias("clips"), error.alias("error"))


def refined(segments: DataFrame, answers: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """segments with ``text`` refined, ``used`` and ``error``: an answer's texts by local index, a missing or blank one leaves the segment as it was.

    segments: keys, local_index, text. answers: keys and ``raw``, one for a chunk. An answer that isn't
    what was asked for is used for no segment of its chunk. Of texts for one index the last counts.
    """
    v = F.try_parse_json(unfenced(F.col(raw)))
    df = answers.select(*[F.col(k).alias(f"_{k}") for k in keys], v.alias("_v"))
    listed = F.when(_kind(F.col("_v")).startswith("OBJECT"), F.try_variant_get("_v", "$.corrected_segments", "array<variant>"))

    def entry(x: Column) -> Column:
        index, text = F.try_variant_get(x, "$.index", "variant"), F.try_variant_get(x, "$.text", "variant")
        number = F.when(~_kind(index).rlike("^(OBJECT|ARRAY|BOOLEAN)"), F.try_variant_get(index, "$", "double"))
        good = F.coalesce((number == F.floor(number)) & (number >= 0) & (_kind(text) == "STRING"), F.lit(False))
        return F.struct(number.cast("bigint").alias("index"), F.when(good, F.try_variant_get(text, "$", "string")).alias("text"), good.alias("good"))

    df = df.withColumn("_items", F.transform(listed, entry))
    error = F.when(F.col("_v").isNull(), "not JSON").when(F.col("_items").isNull(), "corrected_segments: not a list").when(F.exists("_items", lambda x: ~x["good"]), "corrected_segments: faulty entry")
    df = df.select(*[f"_{k}" for k in keys], error.alias("_error"), F.when(error.isNull(), F.col("_items")).alias("_items"), F.lit(True).alias("_answered"))
    # one join: an answer comes to its chunk's segments whole, and holds no more than these
    both = segments.join(df, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    mine = F.filter("_items", lambda x: x["index"] == F.col("local_index"))
    last = F.get(mine, F.size(mine) - 1)["text"]
    sound = F.col("_answered").isNotNull() & F.col("_error").isNull()
    new = F.when(sound, F.nullif(stripped(last), F.lit("")))
    rest = [c for c in segments.columns if c != "text"]
    return both.select(*rest, F.coalesce(new, stripped(F.col("text"))).alias("text"), sound.alias("used"), F.coalesce("_error", F.when(F.col("_answered").isNull(), "no answer")).alias("error"))


def numbered(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``local_index``, a segment's place (from 0) within its chunk."""
    return segments.withColumn("local_index", (F.row_number().over(Window.partitionBy(*keys).orderBy("idx")) - 1).cast("long"))
