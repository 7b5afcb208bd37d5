"""Sources: tables, segments, subtitle and key|text files, the first available of several."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str, each: int = 4000) -> DataFrame:
    """``df`` by ``key``, about ``each`` rows to a partition at most, so that what a task holds doesn't grow with the table. Its rows are counted."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-df.count() // each)), key)


def files(spark: SparkSession, path: str, pattern: str, limit: int | None = None) -> DataFrame:
    """Files of a folder by a glob of names, the newest first: path, modified, bytes. Contents are not read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    df = df.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).orderBy(F.desc("modified"), "path")
    return df.limit(limit) if limit else df


def json_documents(spark: SparkSession, path: str, schema: str, default: dict | None = None) -> DataFrame:
    """Whole-file JSON of a declared schema; a malformed file gives a row of nulls.

    A path that doesn't exist is an error, unless there is a ``default``: then it is written there, once, and read.
    """
    if default is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            out = fs.create(at, False)
            out.write(bytearray(json.dumps(default, ensure_ascii=False, indent=2).encode()))
            out.close()
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def srt(spark: SparkSession, path: str) -> DataFrame:
    """Cues of SRT files: path, idx, start_ms, end_ms, text. Cues without text or time are dropped."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r", "").alias("v"))
    df = df.select("path", F.posexplode(F.split(F.trim("v"), r"\n\s*\n")).alias("k", "block"))
    time = r"(\d+:\d\d:\d\d[,.]\d{3})\s*-->\s*(\d+:\d\d:\d\d[,.]\d{3})"
    lines = F.split(F.col("block"), "\n")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(time)), True)
    body = F.trim(F.array_join(F.filter(F.transform(F.slice(lines, at.cast("int") + 1, F.size(lines)), lambda x: F.trim(x)), lambda x: x != ""), " "))
    df = df.filter(at > 0).select("path", "k", X.srt_ms(F.regexp_extract("block", time, 1)).alias("start_ms"), X.srt_ms(F.regexp_extract("block", time, 2)).alias("end_ms"), body.alias("text"))
    df = df.filter("text <> ''")
    return df.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("k")) - 1).alias("idx"), "start_ms", "end_ms", "text")


def keyed_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``a|b|text`` or tab separated: key ``a:b`` and text. Blank lines and # comments are skipped, of equal keys the last stays.

    The last is that of the last file by name, then of the last place in it; each file is read whole, for its lines to be
    counted. A line of another shape raises an error when the result is computed.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "v"))
    df = whole.select("file", "line", F.trim(F.regexp_replace("v", "^\ufeff", "")).alias("v")).filter("v <> '' AND NOT startswith(v, '#')")
    part = F.split("v", r"[|\t]", 3)
    part = F.when(F.size(part) == 3, part).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.col("v"))))
    df = df.select("file", "line", part.alias("p")).select("file", "line", F.concat_ws(":", F.trim(F.col("p")[0]), F.trim(F.col("p")[1])).alias("key"), F.trim(F.col("p")[2]).alias("text"))
    return df.groupBy("key").agg(F.max_by("text", F.struct("file", "line")).alias("text"))


def clip_at(clips: DataFrame, number: int, by: Sequence[str] = (), place: str = "place") -> DataFrame:
    """The clips that stand at ``number`` (from 1) of each ``by``; a number below 1, or beyond all clips there are, is an error.

    ``place`` counts from 0.
    """
    if number < 1:
        raise ValueError("clips are counted from 1")
    found = clips.filter(F.col(place) == number - 1)
    if found.isEmpty():
        most = clips.agg(F.max(place)).first()[0]
        raise IndexError(f"there is no clip {number}; the last is {0 if most is None else most + 1}")
    return found


def first_available(sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """For each key all rows of the first source that has any, and its name as ``source_name``."""
    tagged = [df.withColumns({"_priority": F.lit(i), "source_name": F.lit(name)}) for i, (name, df) in enumerate(sources)]
    rows = tagged[0]
    for df in tagged[1:]:
        rows = rows.unionByName(df, allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    return rows.withColumn("_first", F.min("_priority").over(w)).filter("_priority = _first").drop("_priority", "_first")


def segments(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, idx, text, start_c, end_c: a document's lines as timed segments; the clock counts characters, 15 to a second.

    Lines are trimmed and empty ones dropped; a null text has none.
    """
    df = docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("k", "line"))
    df = df.select("doc_id", "k", F.btrim("line", F.lit(" ")).alias("text")).filter("text <> ''")
    w = Window.partitionBy("doc_id").orderBy("k")
    n = F.length("text").cast("long")
    end = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.select("doc_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), "text", (end - n).alias("start_c"), end.alias("end_c"))


def optional(df: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """Equality filters, each left out if its value is blank."""
    for name, value in conditions.items():
        if value not in (None, ""):
            df = df.filter(F.col(name) == value)
    return df


def scan_range(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(max(0, n)).select(F.col("id").alias("i"))


def local_date(text: Column, zone: str) -> Column:
    """Date in a time zone of an ISO time as text; null if it is none. A time without an offset is one of the session's zone."""
    local = F.unix_micros(F.from_utc_timestamp(F.try_to_timestamp(text), zone))
    return F.date_from_unix_date(F.floor(local / 86_400_000_000).cast("int"))
