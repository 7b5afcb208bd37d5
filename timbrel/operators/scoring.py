"""Scores of clips and assets from rules. Points are whole ten-thousandths, so that sums are exact."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicons import LATIN, SCENES, Lexicon

# Subtitle colours on dark, medium and bright pictures.
WHITE_TEXT, CREAM_TEXT, DARK_TEXT = "&H00FFFFFF", "&H00D5E8F5", "&H00202020"


def points(base: int, *rules: tuple[Column, int]) -> Column:
    """``base`` and the points of each rule that holds, within [0, 10000]."""
    s = reduce(lambda a, r: a + F.when(r[0], r[1]).otherwise(0), rules, F.lit(base))
    return F.least(F.greatest(s, F.lit(0)), F.lit(10000)).cast("long")


def _blank(c: Column) -> Column:
    return F.trim(c) == ""


def context_penalty(text: Column, lex: Lexicon) -> Column:
    first = F.transform(X.first_words(text, 6), lambda x: F.btrim(x, F.lit(X.EDGES)))
    listed = F.size(F.filter(first, lambda x: x.isin(*lex.context)))
    head = F.when(F.coalesce(F.get(first, F.lit(0)).isin(*lex.context), F.lit(False)), 1400).otherwise(0)
    return F.when(F.size(first) == 0, 3200).otherwise(F.least(F.lit(2600), head + F.least(F.lit(1200), listed * 350)))


def sub_scores(first: Column, last: Column, before: Column, after: Column, n_words: Column, lex: Lexicon = LATIN) -> dict[str, Column]:
    """beginning, ending, prior, following, resolution, standalone and overall, from the texts at a clip's borders."""
    starts, ends = X.starts_with_continuation(first, lex.starts), X.ends_with_continuation(last, lex.ends)
    stop, payoff = X.ends_with_stop(last), X.has_payoff(last, lex.payoff)
    open_before = ~_blank(before) & ~X.ends_with_stop(before)
    open_after = ~_blank(after) & ~stop
    ctx = context_penalty(first, lex)
    clamp = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(10000)).cast("long")
    rule = lambda c, p: F.when(c, p).otherwise(0)
    beginning = F.when(_blank(first), 0).otherwise(clamp(7400 - ctx - rule(starts, 3200) - rule(open_before, 800) - rule(X.word_count(first) < 5, 400) - rule(F.trim(first).endswith(":"), 600))).cast("long")
    ending = F.when(_blank(last), 0).otherwise(points(7000, (stop, 1800), (payoff, 1600), (ends, -2800), (open_after, -800))).cast("long")
    prior = clamp(800 + ctx + rule(starts, 2200) + rule(open_before, 800))
    following = points(600, (ends, 2800), (open_after, 1400), (~payoff & ~stop, 600))
    resolution = points(4800, (stop, 1600), (payoff, 2200), (ends, -2200))
    return {"beginning": beginning, "ending": ending, "prior": prior, "following": following, "resolution": resolution}


def standalone(n_words: Column) -> Column:
    """Of columns beginning, ending, prior and following."""
    s = 2400 + F.floor((25 * F.col("beginning") + 25 * F.col("ending") + 14 * (10000 - F.col("prior")) + 12 * (10000 - F.col("following"))) / 100) - F.when(n_words < 16, 800).otherwise(0)
    return F.least(F.greatest(s, F.lit(0)), F.lit(10000)).cast("long")


def overall() -> Column:
    return F.floor((30 * F.col("beginning") + 30 * F.col("ending") + 25 * F.col("standalone") + 15 * F.col("resolution")) / 100).cast("long")


def duration_points(length: Column, shortest: int, longest: int, second: int = 15) -> Column:
    """10000 at the target length, falling to 0 over the width; lengths in characters, ``second`` of them to a second."""
    target = min(max(42 * second, shortest + 8 * second), longest - 3 * second)
    width = max(8 * second, min(16 * second, (longest - shortest) // 2))
    return F.greatest(F.lit(0), 10000 - F.floor(10000 * F.abs(length - target) / width)).cast("long")


def editorial(confidence: Column, duration: Column, length: Column | None = None, second: int = 15) -> Column:
    """Eight weighted parts less the penalties, of the columns of sub_scores() and standalone(); over 59 seconds costs most."""
    parts = 10 * confidence + 23 * F.col("beginning") + 23 * F.col("ending") + 18 * F.col("standalone") + 10 * (10000 - F.col("prior")) + 8 * (10000 - F.col("following")) + 5 * F.col("resolution") + 3 * duration
    rules = [(c, p) for c, p, _ in _weaknesses(length, second)]
    return (F.floor(parts / 100) - reduce(lambda a, r: a + F.when(r[0], r[1]).otherwise(0), rules, F.lit(0))).cast("long")


def _weaknesses(length: Column | None, second: int) -> list[tuple[Column, int, str]]:
    return [
        (F.col("beginning") < 5200, 1200, "weak_beginning_completeness"), (F.col("ending") < 5400, 1400, "weak_ending_completeness"), (F.col("standalone") < 5200, 1200, "not_fully_self_contained"),
        (F.col("prior") > 4800, 1200, "depends_on_prior_context"), (F.col("following") > 4800, 1400, "depends_on_following_context"), (F.col("resolution") < 4600, 600, "limited_resolution"),
        (length > 59 * second if length is not None else F.lit(False), 5000, "over_59_seconds"),
    ]


def in_range(points: Column, length: Column, shortest: int, longest: int) -> Column:
    """Points of a clip, -1 if its length is forbidden."""
    return F.when(length.between(shortest, longest), points).otherwise(-1).cast("long")


def editorial_notes(first: Column, last: Column, before: Column, length: Column, lex: Lexicon = LATIN, second: int = 15) -> Column:
    """What speaks for and against a clip, in the order of the rules, as an array."""
    rules = [
        (X.starts_with_continuation(first, lex.starts), "starts_like_continuation"), (~_blank(before) & ~X.ends_with_stop(before), "previous_segment_not_closed"), (X.ends_with_continuation(last, lex.ends), "ends_like_continuation"),
        (X.ends_with_stop(last), "clean_terminal_punctuation"), (X.has_payoff(last, lex.payoff), "ending_contains_payoff_signal"), (length.between(30 * second, 59 * second), "complete_under_60"),
    ] + [(c, n) for c, _, n in _weaknesses(length, second)]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in rules]), lambda x: x.isNotNull())


def passes_gates(length: Column, second: int = 15) -> Column:
    """The seven hard limits of a clip."""
    return (
        (length <= 59 * second) & (F.col("beginning") >= 5000) & (F.col("ending") >= 5200) & (F.col("standalone") >= 5000)
        & (F.col("prior") <= 5400) & (F.col("following") <= 5400) & (F.col("overall") >= 5200)
    )


def local_window_parts(first: Column, last: Column, after: Column, lex: Lexicon = LATIN) -> dict[str, Column]:
    """opening, ending and alone of a window, from the texts at its borders."""
    starts, ends = X.starts_with_continuation(first, lex.starts), X.ends_with_continuation(last, lex.ends)
    rule = lambda c, p: F.when(c, p).otherwise(0)
    return {
        "opening": 7000 - rule(starts, 3600) + rule(X.word_count(first) <= 8, 600),
        "ending": 6200 + rule(X.ends_with_stop(last), 2000) + rule(X.has_payoff(last, lex.payoff), 800) - rule(ends, 3000) - rule(~_blank(after) & X.starts_with_continuation(after, lex.starts), 1000),
        "alone": 6600 - rule(starts, 2200) - rule(ends, 1800),
    }


def local_window_points(first: Column, last: Column, after: Column, length: Column, lex: Lexicon = LATIN, second: int = 15) -> Column:
    """The refiner's score of a window: opening, ending, standing alone, and length around 28 seconds."""
    p = local_window_parts(first, last, after, lex)
    return local_points(p["opening"], p["ending"], p["alone"], length, second)


def local_points(opening: Column, ending: Column, alone: Column, length: Column, second: int = 15) -> Column:
    time = F.greatest(F.lit(0), 10000 - F.floor(10000 * F.abs(length - 28 * second) / (10 * second)))
    return F.when(length <= 0, -1).otherwise(F.floor((30 * opening + 34 * ending + 22 * alone + 14 * time) / 100)).cast("long")


def asset_rules(video: Column, width: Column, height: Column, ms: Column, fps: Column, size: Column) -> tuple[Column, Column]:
    """Technical score and flags of an asset: 100 less the points of each rule that holds."""
    top = F.greatest(width, height)
    bad = (width <= 0) | (height <= 0)
    rules = [
        ("could_not_read_dimensions", bad, 30), ("resolution_below_720", ~bad & (top < 720), 25), ("resolution_below_1080", ~bad & (top >= 720) & (top < 1080), 10),
        ("not_portrait", ~bad & video & (height <= width), 10), ("duration_missing", video & (ms <= 0), 20), ("very_short_video", video & (ms > 0) & (ms < 1200), 15),
        ("long_for_insert", video & (ms > 12000), 5), ("low_frame_rate", video & (fps > 0) & (fps < 20), 15), ("small_file_size", size < 120000, 10),
    ]
    score = reduce(lambda a, r: a - F.when(r[1], r[2]).otherwise(0), rules, F.lit(100))
    flags = F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c, _ in rules]), lambda x: x.isNotNull()), ",")
    return F.least(F.greatest(score, F.lit(0)), F.lit(100)).cast("long"), flags


def prompt_tokens(text: Column, stop: Sequence[str]) -> Column:
    """Distinct lower-case tokens of three characters or more that aren't stop words; hyphens inside a token stay."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[،,:;؛.!?؟]", " ")
    t = F.split(F.regexp_replace(t, r"(?U)[^\p{L}\p{N}_\u0600-\u06FF\s-]", " "), r"(?U)\s+")
    t = F.array_distinct(F.filter(F.transform(t, lambda x: F.btrim(x, F.lit("-_"))), lambda x: F.length(x) >= 3))
    return F.array_except(t, F.array(*[F.lit(s) for s in stop]).cast("array<string>"))


def prompt_match(prompt: Column, text: Column, stop: Sequence[str], scenes: Sequence[str] = SCENES) -> dict[str, Column]:
    """points, matched (the first twelve common tokens in order) and note of a prompt against a clip's text."""
    common = F.sort_array(F.array_intersect(prompt_tokens(prompt, stop), prompt_tokens(text, stop)))
    low = F.lower(F.coalesce(prompt, F.lit("")))
    scene = reduce(lambda a, w: a | F.contains(low, F.lit(w)), scenes, F.lit(False))
    nobody = F.contains(low, F.lit("no people")) & F.contains(low, F.lit("no animals"))
    total = 3500 + F.least(F.lit(3500), 800 * F.size(common)) + F.when(scene, 1000).otherwise(0) + F.when(nobody, 1000).otherwise(0) - F.when(F.length(F.coalesce(prompt, F.lit(""))) > 200, 800).otherwise(0)
    total = F.least(F.greatest(total, F.lit(0)), F.lit(10000)).cast("long")
    note = F.when(total >= 7000, "Good symbolic fit").when(total >= 5000, "Usable but generic").otherwise("Weak semantic fit")
    return {"points": total, "matched": F.slice(common, 1, 12), "note": note}


def luma(r: Column, g: Column, b: Column) -> Column:
    """Rec. 601 luma of 0-255 components, in thousandths."""
    return (299 * r + 587 * g + 114 * b).cast("long")


def text_colour(luma: Column) -> Column:
    """Subtitle colour by luma (0-255) in three zones; unknown counts as mid-grey."""
    l = F.coalesce(luma, F.lit(128))
    return F.when(l >= 170, F.lit(DARK_TEXT)).when(l >= 80, F.lit(CREAM_TEXT)).otherwise(F.lit(WHITE_TEXT))


def sample_times(ms: Column, n: int) -> Column:
    """Where to look at frames: 0 without a duration, 0 and the middle up to two seconds, else 2 to 6 inner points."""
    n = max(2, min(n, 6))
    inner = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.greatest(F.lit(0), F.least(ms - 50, F.round(ms * k / (n + 1)).cast("long"))))
    two = F.array(F.lit(0).cast("long"), F.floor(ms / 2).cast("long"))
    return F.when(ms <= 0, F.array(F.lit(0).cast("long"))).when(ms <= 2000, two).otherwise(F.sort_array(F.array_distinct(inner))).cast("array<long>")


def insert_ratio(ms: Column, mode: Column, padding_ms: int = 0) -> Column:
    """How many scenic inserts a clip gets and how long they are, by duration and mode; a struct, times in milliseconds.

    Unknown modes are ``balanced``; a clip counts as a second long at least. ``padding_ms`` is added to
    an insert for both of its dissolves. ratio4 is the scenic share in ten-thousandths.
    """
    d = F.greatest(F.lit(1000), ms)
    m = F.lower(F.trim(F.coalesce(mode, F.lit(""))))
    m = F.when(m.isin("light", "balanced", "cinematic"), m).otherwise("balanced")
    many = F.when(d < 22000, 1).when(d < 38000, 2).otherwise(3)
    n = F.when(m == "light", F.greatest(F.lit(1), many - 1)).otherwise(many)
    by = lambda light, cinematic, balanced: F.when(m == "light", light).when(m == "cinematic", cinematic).otherwise(balanced)
    each = by(F.lit(1600), F.when(many <= 2, 2200).otherwise(1800), F.when(many <= 2, 1900).otherwise(1700)) + 2 * padding_ms
    scenic = F.least(F.floor(d * 42 / 100), n * each)
    return F.struct(m.alias("mode"), n.cast("long").alias("inserts"), each.cast("long").alias("insert_ms"), by(2100, 1700, 1900).cast("long").alias("intro_ms"), by(2100, 1800, 2000).cast("long").alias("outro_ms"), scenic.cast("long").alias("scenic_ms"), F.floor(10000 * scenic / d).cast("long").alias("ratio4"))


def window_reasons(ds: Column, de: Column, opening: Column, ending: Column) -> Column:
    """Why a window was suggested, of its shifts and the points of its ends."""
    parts = F.filter(F.array(F.when(ds != 0, F.lit("start_adjusted_to_segment_boundary")), F.when(de != 0, F.lit("end_adjusted_to_complete_thought")), F.when(ending >= 7800, F.lit("ending_scores_strong")), F.when(opening >= 7200, F.lit("opening_scores_clean"))), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(F.lit("kept_original_boundaries"))
