"""Sinks for files. Tables that are changed in place are in ``store``.

Spark's ``overwrite`` deletes the old folder before the new one is whole; replace_json() doesn't.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def srt_text(segments: DataFrame, keys: Sequence[str], number_all: bool = True) -> DataFrame:
    """keys, srt: one subtitle file as text for each key.

    ``number_all`` numbers the cues that are written; else cues without text are left out and
    the others keep the number of their place.
    """
    w = Window.partitionBy(*keys).orderBy("idx")
    rows = segments.filter("trim(text) <> ''") if number_all else segments
    rows = rows.withColumn("_n", F.row_number().over(w)).filter("trim(text) <> ''")
    cue = F.concat_ws("\n", F.col("_n").cast("string"), F.concat_ws(" --> ", X.srt_time(F.col("start_ms")), X.srt_time(F.col("end_ms"))), F.trim("text"), F.lit(""))
    listed = F.sort_array(F.collect_list(F.struct("_n", cue.alias("cue"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["cue"]), "\n").alias("srt"))


def ass_line(start_cs: Column, end_cs: Column, text: Column, style: str = "Default", lead: str = "", right_to_left: bool = False) -> Column:
    """One event line of an ASS subtitle file; braces are escaped, line ends become soft breaks."""
    safe = X.ass_escape(F.replace(text, F.lit("\n"), F.lit("\\N")))
    safe = X.rtl_lines(safe) if right_to_left else safe
    return F.concat(F.lit("Dialogue: 0,"), X.ass_time(start_cs), F.lit(","), X.ass_time(end_cs), F.lit(f",{style},,0,0,0,,{lead}"), safe)


def ass_header(width: int = 1080, height: int = 1920, font: str = "Arial", size: int = 64, colour: str = "&H00FFFFFF") -> str:
    """Script, style and event sections up to the first event line."""
    fields = ("Name", "Fontname", "Fontsize", "PrimaryColour", "Alignment", "MarginL", "MarginR", "MarginV")
    return "\n".join([
        "[Script Info]", "ScriptType: v4.00+", f"PlayResX: {width}", f"PlayResY: {height}", "", "[V4+ Styles]", "Format: " + ", ".join(fields),
        f"Style: Default,{font},{size},{colour},5,40,40,40", "", "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text", "",
    ])


def ass_text(events: DataFrame, keys: Sequence[str], header: str, **how) -> DataFrame:
    """keys, ass: one subtitle document as text for each key, of events (keys, idx, start_cs, end_cs, text)."""
    rows = events.filter("trim(text) <> ''")
    line = ass_line(F.col("start_cs"), F.col("end_cs"), F.trim("text"), **how)
    listed = F.sort_array(F.collect_list(F.struct("idx", line.alias("line"))))
    return rows.groupBy(*keys).agg(F.concat(F.lit(header), F.array_join(F.transform(listed, lambda x: x["line"]), "\n"), F.lit("\n")).alias("ass"))


def text_files(df: DataFrame, path: str, name: str, text: str) -> None:
    """Write each row's text, line ends and all, under a folder of its name; one file a row."""
    df.select(F.col(name), F.col(text).alias("value")).write.mode("overwrite").partitionBy(name).text(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` rows, and those of ``old`` whose keys aren't among them. Keys are null-safe."""
    cond = None
    n = new.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    for k in keys:
        c = old[k].eqNullSafe(n[f"_{k}"])
        cond = c if cond is None else cond & c
    return old.join(n, cond, "left_anti").unionByName(new)


def refresh(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Insert unknown keys; of known ones take ``columns`` from ``new`` and keep the rest."""
    n = new.select(*[F.col(c).alias(f"_{c}") for c in new.columns])
    cond = None
    for k in keys:
        c = old[k] == n[f"_{k}"]
        cond = c if cond is None else cond & c
    both = old.join(n, cond, "full_outer")
    take = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in columns else F.coalesce(F.col(c), F.col(f"_{c}")) if c in new.columns else F.col(c)
    return both.select(*[take(c).alias(c) for c in old.columns])


def report(df: DataFrame, keys: Sequence[str], value: Column, failed: Column, error: Column) -> DataFrame:
    """keys, ok, value, error: the result of each item of a batch; one that fails doesn't stop the rest.

    ``value`` must not raise: build it of try_ functions, or make it with attempted().
    """
    return df.select(*keys, (~failed).alias("ok"), F.when(~failed, value).alias("value"), F.when(failed, error).alias("error"))


def attempted(df: DataFrame, keys: Sequence[str], make: Callable[[dict], str]) -> DataFrame:
    """keys, ok, value (text), error: ``make`` called for each row on the executors; what it raises is that row's error."""
    kinds = dict(df.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                try:
                    out.append((*[row[k] for k in keys], True, str(make(row)), None))
                except Exception as exc:
                    out.append((*[row[k] for k in keys], False, None, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(out, columns=[*keys, "ok", "value", "error"])

    return df.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", ok boolean, value string, error string")


def batch_manifest(reported: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """keys, total, succeeded, results: what came of each batch, its items in order."""
    rest = [c for c in reported.columns if c not in keys and c != item]
    return reported.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("ok").alias("succeeded"), F.sort_array(F.collect_list(F.struct(item, *rest))).alias("results"))


def replace_json(df: DataFrame, path: str) -> None:
    """Put ``df`` in place of a folder of JSON: written beside it, then swapped by two renames.

    A write that fails leaves the old folder. Between the renames there is none for a moment; if the run dies
    there, the old one stands beside under its name with ``.old``. For tables that others read
    meanwhile use a KeyedTable.
    """
    spark = df.sparkSession
    draft = f"{path.rstrip('/')}.draft-{uuid.uuid4().hex}"
    df.write.json(draft)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = at(f"{path.rstrip('/')}.old")
    if fs.exists(at(path)):
        fs.delete(old, True)
        fs.rename(at(path), old)
    if not fs.rename(at(draft), at(path)):
        raise OSError(f"could not put {draft} in place")
    fs.delete(old, True)
