"""Subtitle events of clips, word by word: each word lights up in its time, those said before it stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import folds, intervals
from ..sources import sinks

#: Shortest event and the gap between two, in hundredths of a second (fixed values).
SHORTEST, GAP = 4, 3
#: How the active word looks (fixed values: colours, outline, shadow, blur, scale).
ACTIVE = "{\\1c&H007878FF\\3c&H00000000\\4c&H660000FF\\blur1.4\\fscx106\\fscy106}"
#: Marks around a word, so that direction doesn't cross its borders (fixed values).
ISOLATE, RELEASE = "⁨", "⁩"


def revealed_line(words: Column, at: Column) -> Column:
    """The words up to place ``at`` (from 0), the newest first and lit up, each isolated."""
    return _lit_up(F.reverse(F.slice(words, 1, at + 1)))


def _lit_up(shown: Column) -> Column:
    each = F.transform(shown, lambda w, i: F.concat(F.lit(ISOLATE), F.when(i == 0, F.concat(F.lit(ACTIVE), X.ass_escape(w), F.lit("{\\rDefault}"))).otherwise(X.ass_escape(w)), F.lit(RELEASE)))
    return F.array_join(each, " ")


def _timed(clips: DataFrame, words: DataFrame, keys: Sequence[str], group: int, per_second: int) -> DataFrame:
    """keys, seg, pos, word, at (its place in its group), idx, start_cs, end_cs: the words that a clip holds, apart from each other.

    All steps are windows over one order within a document, so rows are sorted once and don't move.
    """
    held = words.withColumn("word", F.struct("word", F.col("idx").alias("seg"), "pos"))
    held = intervals.clamp_words(clips.select(*dict.fromkeys(["doc_id", *keys, "start_c", "end_c"])), held).select(*keys, "word.*", "word_start", "word_end")
    cs = lambda c: F.floor(F.col(c) * 100 / per_second).cast("long")
    nth = F.row_number().over(Window.partitionBy(*keys, "seg").orderBy("pos")) - 1
    rows = held.select(*keys, "seg", "pos", "word", (nth % group).cast("long").alias("at"), cs("word_start").alias("start_c"), cs("word_end").alias("end_c"))
    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy("seg", "pos")) - 1)
    return folds.separate(rows, list(keys), GAP, SHORTEST, ["seg", "pos"], ["seg", "pos", "word", "at"]).withColumnsRenamed({"start_c": "start_cs", "end_c": "end_cs"})


def word_events(clips: DataFrame, words: DataFrame, keys: Sequence[str] = ("doc_id", "place"), group: int = 6, per_second: int = 15) -> DataFrame:
    """keys, idx, start_cs, end_cs, words, at: an event for each word of a clip, with the words of its group up to it.

    words: doc_id, idx (of the segment), pos, word, start_c, end_c. Words are clamped to their clip and counted from its
    start; a segment's words that a clip holds go in groups of ``group``. Events don't overlap, across segments either.
    """
    last = F.collect_list("word").over(Window.partitionBy(*keys, "seg").orderBy("pos").rowsBetween(1 - group, 0))
    rows = _timed(clips, words, keys, group, per_second).withColumn("words", last)
    at = F.col("at").cast("int")
    return rows.select(*keys, "idx", "start_cs", "end_cs", F.slice("words", F.size("words") - at, at + 1).alias("words"), "at")


def word_subtitles(clips: DataFrame, words: DataFrame, keys: Sequence[str] = ("doc_id", "place"), lead: str = "{\\an5\\blur0.8\\bord3.0\\shad1.0}", group: int = 6, per_second: int = 15) -> DataFrame:
    """keys, ass: a subtitle document for each clip that has words. Its lines are made when its words are together, so each word moves once."""
    listed = F.sort_array(F.collect_list(F.struct("idx", "start_cs", "end_cs", F.col("at").cast("int").alias("at"), "word")))
    made = _timed(clips, words, keys, group, per_second).groupBy(*keys).agg(listed.alias("_l"))
    # the column is looked into more than once, so that it stays a column and isn't sorted anew for each line
    shown = lambda x, k: F.transform(F.reverse(F.slice("_l", k - x["at"] + 1, x["at"] + 1)), lambda y: y["word"])
    row = lambda x, k: F.concat(F.lit("Dialogue: 0,"), X.ass_time(x["start_cs"]), F.lit(","), X.ass_time(x["end_cs"]), F.lit(",Default,,0,0,0,,"), F.lit(lead), _lit_up(shown(x, k)))
    return made.select(*keys, F.concat(F.lit(sinks.ass_header()), F.array_join(F.transform("_l", row), "\n"), F.lit("\n")).alias("ass"))
