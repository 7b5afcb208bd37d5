"""Composite plans over segments: finding clips, repairing their borders, planning their beats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicons import LATIN, Lexicon
from ..operators import folds, intervals, scoring

#: Shortest and longest clip, in characters of the segment clock (20 and 59 seconds).
SHORTEST, LONGEST = 300, 885
#: Overlap, in per cent of the shorter clip, from which the later one goes.
SAME = 70


def scored_windows(seg: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """doc_id, start_idx, end_idx, start_c, end_c, points: windows by duration, with a bonus for a closed end."""
    pairs = intervals.window_pairs(seg, shortest, longest)
    stop = seg.select(F.col("doc_id").alias("_d"), F.col("idx").alias("_i"), F.trim("text").rlike(r"[.!?]$").alias("stop"))
    both = pairs.join(stop, (F.col("doc_id") == F.col("_d")) & (F.col("end_idx") == F.col("_i")))
    points = scoring.duration_points(F.col("end_c") - F.col("start_c"), shortest, longest) + F.when(F.col("stop"), 1800).otherwise(0)
    return both.select("doc_id", "start_idx", "end_idx", "start_c", "end_c", points.alias("points"))


def find_clips(seg: DataFrame, same: int = SAME) -> DataFrame:
    """Windows in order of points, each kept unless it mostly repeats a better one: + place (from 0)."""
    order = [-F.col("points"), F.col("start_idx"), F.col("end_idx")]
    return folds.suppress(scored_windows(seg), ["doc_id"], order, same, ("start_idx", "end_idx", "start_c", "end_c", "points"))


def border_scores(seg: DataFrame, lex: Lexicon = LATIN, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Each segment once as a clip's first and once as its last: numbers alone, so windows needn't carry texts."""
    from pyspark.sql import Window

    near = intervals.neighbours(seg, key).withColumn("_w", F.size(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "")))
    near = near.withColumn("_cum", F.sum("_w").over(Window.partitionBy(key).orderBy("idx")))
    s = scoring.sub_scores(F.col("text"), F.col("text"), F.col("prev_text"), F.col("next_text"), F.col("_w"), lex)
    at = lambda k, i: (F.col(key).alias(k), F.col("idx").alias(i))
    first = near.select(*at("_ka", "_ia"), s["beginning"].alias("beginning"), s["prior"].alias("prior"), X.starts_with_continuation(F.col("text"), lex.starts).alias("_continues"), F.col("start_c").alias("_start_c"), (F.col("_cum") - F.col("_w")).alias("_w0"))
    last = near.select(*at("_kb", "_ib"), s["ending"].alias("ending"), s["following"].alias("following"), s["resolution"].alias("resolution"), F.col("end_c").alias("_end_c"), F.col("_cum").alias("_w1"))
    return first, last


def with_sub_scores(windows: DataFrame, seg: DataFrame, lex: Lexicon = LATIN, key: str = "doc_id", whole_start: bool = False) -> DataFrame:
    """windows (doc_id, s, e) with the sub-scores of their borders and start_c, end_c, length.

    ``whole_start``: windows whose first segment continues another are left out.
    """
    first, last = border_scores(seg, lex, key)
    if whole_start:
        first = first.filter(~F.col("_continues"))
    both = windows.drop("start_c", "end_c").join(first, (F.col(key) == F.col("_ka")) & (F.col("s") == F.col("_ia"))).join(last, (F.col(key) == F.col("_kb")) & (F.col("e") == F.col("_ib")))
    both = both.withColumn("standalone", scoring.standalone(F.col("_w1") - F.col("_w0"))).withColumn("overall", scoring.overall())
    both = both.withColumnsRenamed({"_start_c": "start_c", "_end_c": "end_c"}).withColumn("length", F.col("end_c") - F.col("start_c"))
    return both.drop("_ka", "_ia", "_kb", "_ib", "_w0", "_w1", "_continues")


def heuristic_clips(seg: DataFrame, most: int, shortest: int = SHORTEST, longest: int = LONGEST, same: int = SAME, lex: Lexicon = LATIN) -> DataFrame:
    """doc_id, place, start_idx, end_idx, start_c, end_c, editorial: the best windows by their editorial points.

    Every window of an allowed length whose first segment doesn't continue another is scored with
    a confidence of one half; those below zero go. In order of points, then of length, each is kept
    unless it mostly repeats a better one, until 16 times ``most`` are (callers cut later).
    """
    pairs = intervals.window_pairs(seg, shortest, longest).select("doc_id", F.col("start_idx").alias("s"), F.col("end_idx").alias("e"))
    w = with_sub_scores(pairs, seg, lex, whole_start=True)
    w = w.withColumn("editorial", scoring.editorial(F.lit(5000), scoring.duration_points(F.col("length"), shortest, longest), F.col("length"))).filter("editorial >= 0")
    w = w.withColumnsRenamed({"s": "start_idx", "e": "end_idx"})
    order = [-F.col("editorial"), -F.col("length"), F.col("start_idx"), F.col("end_idx")]
    return folds.suppress(w, ["doc_id"], order, same, ("start_idx", "end_idx", "start_c", "end_c", "editorial"), 16 * most)


def finished_clips(seg: DataFrame, most: int, shortest: int = SHORTEST, longest: int = LONGEST, lex: Lexicon = LATIN) -> DataFrame:
    """doc_id, place, start_idx, end_idx, start_c, end_c, editorial: found, repaired, gated, de-duplicated, in order, cut to ``most``."""
    found = heuristic_clips(seg, most, shortest, longest, lex=lex)
    confidence = F.least(F.lit(10000), F.greatest(F.lit(0), F.floor((F.col("editorial") + 5) / 10) * 10))
    ready = repair_borders(found.select("doc_id", "place", "start_idx", "end_idx", confidence.alias("confidence")), seg, shortest, longest, lex).filter("passed")
    ready = ready.select("doc_id", F.col("place").alias("_p"), F.col("best_s").alias("start_idx"), F.col("best_e").alias("end_idx"), "start_c", "end_c", F.least(F.lit(10000), F.greatest(F.lit(0), F.col("best_editorial"))).cast("long").alias("editorial"), "ending", "beginning", "standalone")
    order = [-F.col("editorial"), -F.col("ending"), -F.col("beginning"), -F.col("standalone"), F.col("end_c") - F.col("start_c"), F.col("start_c"), F.col("_p")]
    kept = folds.suppress(ready, ["doc_id"], order, 68, ("start_idx", "end_idx", "start_c", "end_c", "editorial")).drop("place")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("editorial"), "start_c", "start_idx", "end_idx")) - 1
    return kept.withColumn("place", place.cast("long")).filter(F.col("place") < most).select("doc_id", "place", "start_idx", "end_idx", "start_c", "end_c", "editorial")


def repair_borders(clips: DataFrame, seg: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, lex: Lexicon = LATIN) -> DataFrame:
    """clips (doc_id, start_idx, end_idx and more) with their best shifted window: best_s, best_e, best_editorial, passed, its scores and times.

    A column ``confidence`` (0 to 10000) counts for the editorial points; without it one half does.

    All shifts of -4..2 and -2..4 segments are scored; the best has most editorial points, then
    ending, beginning, and the smaller s and e. Windows of a forbidden length don't compete.
    """
    last = seg.groupBy(F.col("doc_id").alias("_d")).agg(F.max("idx").alias("last_idx"))
    grid = intervals.shift_grid(clips.join(last, F.col("doc_id") == F.col("_d")).drop("_d"), (-4, 2), (-2, 4), F.col("last_idx")).drop("last_idx")
    scored = with_sub_scores(grid, seg, lex).filter(F.col("length").between(shortest, longest))
    confidence = F.col("confidence") if "confidence" in clips.columns else F.lit(5000)
    scored = scored.withColumn("editorial", scoring.editorial(confidence, scoring.duration_points(F.col("length"), shortest, longest), F.col("length")))
    scored = scored.withColumn("passed", scoring.passes_gates(F.col("length")))
    key = F.struct("editorial", "ending", "beginning", (-F.col("s")).alias("s"), (-F.col("e")).alias("e"))
    got = {"best_s": "s", "best_e": "e", "best_editorial": "editorial", "passed": "passed", "ending": "ending", "beginning": "beginning", "standalone": "standalone", "start_c": "start_c", "end_c": "end_c"}
    keys = [c for c in clips.columns if c not in ("confidence", "start_c", "end_c")]
    best = scored.groupBy(*keys).agg(F.max_by(F.struct(*got.values()), key).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(n) for n, c in got.items()])


def refined_windows(clips: DataFrame, seg: DataFrame, lex: Lexicon = LATIN, second: int = 15) -> DataFrame:
    """clips (doc_id, place, start_idx, end_idx) with the best window nearby: s, e, points and the reasons.

    Shifts of -1..1 and -1..2 segments compete by points, then ending, opening, a length near 28
    seconds, and the smaller shift. A window without a length doesn't compete.
    """
    near = intervals.neighbours(seg)
    parts = scoring.local_window_parts(F.col("text"), F.col("text"), F.col("next_text"), lex)
    flag = lambda c, p: F.when(c, p).otherwise(0)
    a = near.select(F.col("doc_id").alias("_a"), F.col("idx").alias("_ai"), parts["opening"].alias("opening"), flag(X.starts_with_continuation(F.col("text"), lex.starts), 2200).alias("_lean"), "start_c")
    b = near.select(F.col("doc_id").alias("_b"), F.col("idx").alias("_bi"), parts["ending"].alias("ending"), flag(X.ends_with_continuation(F.col("text"), lex.ends), 1800).alias("_open"), "end_c")
    last = seg.groupBy(F.col("doc_id").alias("_d")).agg(F.max("idx").alias("last_idx"))
    g = intervals.shift_grid(clips.join(last, F.col("doc_id") == F.col("_d")).drop("_d"), (-1, 1), (-1, 2), F.col("last_idx"), unique=False)
    both = g.join(a, (F.col("doc_id") == F.col("_a")) & (F.col("s") == F.col("_ai"))).join(b, (F.col("doc_id") == F.col("_b")) & (F.col("e") == F.col("_bi")))
    length = F.col("end_c") - F.col("start_c")
    both = both.withColumn("points", scoring.local_points(F.col("opening"), F.col("ending"), 6600 - F.col("_lean") - F.col("_open"), length, second)).filter("points >= 0")
    both = both.withColumn("reason", scoring.window_reasons(F.col("s") - F.col("start_idx"), F.col("e") - F.col("end_idx"), F.col("opening"), F.col("ending")))
    key = F.struct("points", "ending", "opening", (-F.abs(length - 28 * second)).alias("near"), (-F.col("s")).alias("s"), (-F.col("e")).alias("e"))
    best = both.groupBy("doc_id", "place").agg(F.max_by(F.struct("s", "e", "points", "reason"), key).alias("r"))
    return best.select("doc_id", "place", F.col("r.s").cast("long").alias("s"), F.col("r.e").cast("long").alias("e"), "r.points", "r.reason")


def two_beats(clips: DataFrame, length: str, hold: int = 45, second: int = 15) -> DataFrame:
    """clips, kind, beat_start, beat_end: the original up to the intro, then stock; one beat if too little is left."""
    d = F.col(length)
    intro = F.least(F.lit(max(hold, second * 5 // 2)), F.greatest(F.lit(18), d - 18)).cast("long")
    one = F.array(F.struct(F.lit("original").alias("kind"), F.lit(0).cast("long").alias("beat_start"), d.alias("beat_end")))
    two = F.array(F.struct(F.lit("original").alias("kind"), F.lit(0).cast("long").alias("beat_start"), intro.alias("beat_end")), F.struct(F.lit("stock_video").alias("kind"), intro.alias("beat_start"), d.alias("beat_end")))
    return clips.select(*clips.columns, F.explode(F.when(d - intro < 18, one).otherwise(two)).alias("_b")).select(*clips.columns, "_b.*")


def crossfades(beats: DataFrame, key: str, fade_ms: int) -> DataFrame:
    """key, idx, fade_ms, offset_ms of each beat but the first, of beats (key, idx, ms)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("idx")
    fade = F.greatest(F.lit(50), F.least(F.lit(fade_ms), F.floor(F.lag("ms").over(w) / 2), F.floor(F.col("ms") / 2))).cast("long")
    df = beats.withColumn("_t", F.when(F.lag("ms").over(w).isNotNull(), fade))
    run = w.rowsBetween(Window.unboundedPreceding, -1)
    sofar = F.coalesce(F.sum("ms").over(run), F.lit(0)) - F.coalesce(F.sum("_t").over(run), F.lit(0))
    return df.withColumn("_o", F.greatest(F.lit(0), sofar - F.col("_t")).cast("long")).filter("_t IS NOT NULL").select(key, "idx", F.col("_t").alias("fade_ms"), F.col("_o").alias("offset_ms"))


def word_times(seg: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, idx, pos, word, word_start, word_end: a segment's time dealt to its words by their letters; the last ends with it."""
    from pyspark.sql import Window

    df = seg.select(key, "idx", "start_c", "end_c", F.posexplode(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "")).alias("pos", "word")).withColumn("_n", F.length("word").cast("long"))
    w = Window.partitionBy(key, "idx")
    run = w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_c": F.sum("_n").over(run), "_all": F.sum("_n").over(w)})
    at = lambda c: F.col("start_c") + F.floor((F.col("end_c") - F.col("start_c")) * c / F.col("_all")).cast("long")
    return df.select(key, "idx", F.col("pos").cast("long").alias("pos"), "word", at(F.col("_c") - F.col("_n")).alias("word_start"), at(F.col("_c")).alias("word_end"))
