"""Ordered, stateful operators: one native fold over a key's rows in order.

A fold gathers one key's rows (a document's, a clip's) into an array. Where a key may have very
many rows, cut them into independent parts first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[Column], carry: Sequence[str], init: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """keys, state: ``step(state, row)`` over a key's rows in order; a row is a struct of ``carry``."""
    names = [f"_o{i}" for i in range(len(order))]
    rows = F.sort_array(F.collect_list(F.struct(*[o.alias(n) for o, n in zip(order, names, strict=True)], *carry)))
    return df.groupBy(*keys).agg(F.aggregate(rows, init, step).alias("state"))


def suppress(cands: DataFrame, keys: Sequence[str], order: Sequence[Column], percent: int, carry: Sequence[str] = ("start_idx", "end_idx", "start_c", "end_c"), most: int | None = None) -> DataFrame:
    """Greedy interval suppression: in order, keep a row unless it overlaps a kept one by ``percent`` of the shorter of the two.

    ``most``: no more rows than that are kept (a top-k). A row without length overlaps none.
    """
    kept = "array<struct<" + ",".join(f"{c}:bigint" for c in carry) + ">>"
    overlap = lambda a, b: F.least(a["end_c"], b["end_c"]) - F.greatest(a["start_c"], b["start_c"])
    shorter = lambda a, b: F.least(a["end_c"] - a["start_c"], b["end_c"] - b["start_c"])

    def step(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda y: (shorter(x, y) > 0) & (100 * overlap(x, y) >= percent * shorter(x, y)))
        if most is not None:
            clash = (F.size(acc) >= most) | clash
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(F.struct(*[x[c].cast("long").alias(c) for c in carry]))))

    out = ordered_fold(cands, keys, order, carry, F.array().cast(kept), step)
    return out.select(*keys, F.posexplode("state").alias("place", "r")).select(*keys, F.col("place").cast("long").alias("place"), "r.*")


def drop_adjacent_repeats(seg: DataFrame, gap: int, key: str = "doc_id") -> DataFrame:
    """Drop a segment whose text equals the last kept one's, if both its ends are less than ``gap`` away from that one's.

    The last kept text is always that of the segment before, so a change of text begins an island of its own, and a
    fold holds no more than one run of equal texts. A null text equals none.
    """
    w = Window.partitionBy(key).orderBy("idx")
    same = F.coalesce(F.col("text") == F.lag("text").over(w), F.lit(False))
    runs = seg.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    row = lambda x: F.struct(x["idx"].cast("long").alias("idx"), x["start_c"].alias("start_c"), x["end_c"].alias("end_c"))
    start = F.struct(F.lit(None).cast("bigint").alias("s"), F.lit(None).cast("bigint").alias("e"), F.array().cast("array<struct<idx:bigint,start_c:bigint,end_c:bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        near = F.coalesce((F.abs(x["start_c"] - a["s"]) < gap) & (F.abs(x["end_c"] - a["e"]) < gap), F.lit(False))
        kept = F.struct(x["start_c"].cast("long").alias("s"), x["end_c"].cast("long").alias("e"), F.concat(a["out"], F.array(row(x))).alias("out"))
        return F.when(near, a).otherwise(kept)

    # runs lie within their key's partition, so this takes no shuffle of its own
    listed = F.sort_array(F.collect_list(F.struct("idx", "start_c", "end_c")))
    out = runs.groupBy(key, "_run").agg(F.min("text").alias("text"), F.aggregate(listed, start, step).alias("state"))
    return out.select(key, "text", F.explode("state.out").alias("r")).select(key, "r.*", "text")


def bounded_chunks(seg: DataFrame, most: int, chars: int, key: str = "doc_id") -> DataFrame:
    """key, idx, chunk: a new chunk begins when the open one holds ``most`` rows, or would exceed ``chars`` with this one.

    A row counts with its label ``[k] ``, k being its place if no new chunk began.
    """
    start = F.struct(F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("c"), F.array().cast("array<struct<idx:bigint,chunk:bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        size = x["size"] + 3 + F.length((a["n"] + 1).cast("string"))
        fresh = (a["n"] > 0) & ((a["n"] >= most) | (a["c"] + size > chars))
        chunk = a["chunk"] + F.when(fresh, 1).otherwise(0)
        return F.struct(
            chunk.cast("long").alias("chunk"), F.when(fresh, F.lit(1)).otherwise(a["n"] + 1).cast("long").alias("n"), F.when(fresh, size).otherwise(a["c"] + size).cast("long").alias("c"),
            F.concat(a["out"], F.array(F.struct(x["idx"].cast("long").alias("idx"), chunk.cast("long").alias("chunk")))).alias("out"),
        )

    out = ordered_fold(seg.withColumn("size", F.length("text").cast("long")), [key], [F.col("idx")], ["idx", "size"], start, step)
    return out.select(key, F.explode("state.out").alias("r")).select(key, "r.*")


def tile(best: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-to-right tiling. ``best``: keys, idx, size (of the window taken if the walk stands there); returns those where it stands."""
    start = F.struct(F.lit(0).cast("long").alias("next"), F.array().cast("array<struct<idx:bigint,size:bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        here = F.struct((x["idx"] + x["size"]).cast("long").alias("next"), F.concat(a["out"], F.array(F.struct(x["idx"].cast("long").alias("idx"), x["size"].cast("long").alias("size")))).alias("out"))
        return F.when(x["idx"] == a["next"], here).otherwise(a)

    out = ordered_fold(best, keys, [F.col("idx")], ["idx", "size"], start, step)
    return out.select(*keys, F.explode("state.out").alias("r")).select(*keys, "r.*")


def separate(events: DataFrame, keys: Sequence[str], gap: int, shortest: int, order: Sequence[str] = ("idx",), carry: Sequence[str] = ()) -> DataFrame:
    """Events in order that no longer overlap: each starts ``gap`` after the end before it at the earliest, and lasts ``shortest`` at least.

    Each end is the greatest of the ends before it, pushed on by ``gap + shortest`` for every event since; so a
    running maximum does, and no state grows with a key's rows. Times aren't negative, ``shortest`` is above 0.
    ``order`` tells how events follow each other, ``carry`` which columns come along (those of another order too).
    """
    if shortest <= 0:
        raise ValueError("events must last a while")
    w = Window.partitionBy(*keys).orderBy(*order)
    step = gap + shortest
    place = F.row_number().over(w).cast("long")
    own = F.greatest(F.col("end_c"), F.col("start_c") + shortest)
    rows = events.select(*keys, *carry, F.col("idx").cast("long").alias("idx"), "start_c", place.alias("_i"), own.alias("_own"))
    rows = rows.withColumn("_end", F.max(F.col("_own") - F.col("_i") * step).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_i") * step)
    start = F.greatest(F.col("start_c"), F.coalesce(F.lag("_end").over(w) + gap, F.col("start_c")))
    return rows.select(*keys, *carry, "idx", start.cast("long").alias("start_c"), F.col("_end").cast("long").alias("end_c"))


def fixed_chunks(seg: DataFrame, n: int) -> DataFrame:
    return seg.withColumn("chunk", F.floor(F.col("idx") / n).cast("long"))


def fill_gaps(inserts: DataFrame, keys: Sequence[str], length: str, hold: int, shortest: int, least_gap: int) -> DataFrame:
    """keys, kind, start_c, end_c: inserts clamped to [hold, length - hold], and the gaps around them.

    Inserts shorter than ``shortest`` go, gaps shorter than ``least_gap`` stay open. A key's
    ``length`` comes with each insert; a row without an insert (null start) gives only its gap.
    """
    s, e = F.greatest("start_c", F.lit(hold)), F.least("end_c", F.col(length) - hold)
    kept = inserts.filter("start_c IS NOT NULL").select(*keys, length, s.alias("start_c"), e.alias("end_c")).filter(F.col("end_c") - F.col("start_c") >= shortest)
    w = Window.partitionBy(*keys).orderBy("start_c", "end_c")
    before = F.coalesce(F.max("end_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    gaps = kept.select(*keys, before.alias("lo"), F.col("start_c").alias("hi"))
    ends = inserts.select(*keys, length).distinct().join(kept.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("end_c").alias("top")), on=[F.col(k) == F.col(f"_{k}") for k in keys], how="left")
    gaps = gaps.unionByName(ends.select(*keys, F.coalesce("top", F.lit(0).cast("long")).alias("lo"), F.col(length).alias("hi")))
    gaps = gaps.filter(F.col("hi") - F.col("lo") >= least_gap).select(*keys, F.lit("original").alias("kind"), F.col("lo").alias("start_c"), F.col("hi").alias("end_c"))
    return kept.select(*keys, F.lit("insert").alias("kind"), "start_c", "end_c").unionByName(gaps)


def schedule_beats(clips: DataFrame, keys: Sequence[str], length: str, inserts: Column | None = None, insert_cs: Column | None = None, intro_cs: Column | None = None, outro_cs: Column | None = None, rest: int = 70, lead: int = 65, least: int = 110, gap: int = 30, shortest: int = 20) -> DataFrame:
    """keys, length, kind, slot, beat_start, beat_end, notes: up to three inserts around fixed centres of a clip, the original between them.

    All times are hundredths of a second. Numbers and lengths are the balanced mode's unless given (see scoring.insert_ratio()).
    An insert starts ``rest`` after the one before it (the first may start ``lead`` before the intro's end plus
    that), at the latest so that it ends with the outro's begin, and is left out if under ``least``. Gaps of
    ``gap`` or more get the original; a clip without any insert is original throughout. A clip may have fewer
    ideas than inserts: ``inserts`` is then their number, and 0 leaves the original whole.
    """
    d = F.col(length)
    n = inserts if inserts is not None else F.when(d < 2200, 1).when(d < 3800, 2).otherwise(3)
    size = insert_cs if insert_cs is not None else F.when(d < 3800, 190).otherwise(170)
    intro, outro = (c if c is not None else F.lit(v) for c, v in ((intro_cs, 190), (outro_cs, 200)))
    centres = F.when(n <= 0, F.array().cast("array<int>")).when(n == 2, F.array(F.lit(36), F.lit(70))).when(n >= 3, F.array(F.lit(24), F.lit(52), F.lit(78))).otherwise(F.array(F.lit(50)))
    out = clips.withColumns({"_n": n, "_size": size.cast("long"), "_intro": intro.cast("long"), "_outro": outro.cast("long"), "_at": centres})
    late = F.greatest(F.col("_intro"), d - F.col("_outro") - F.col("_size"))
    start = F.struct(F.greatest(F.lit(0), F.col("_intro") - lead).cast("long").alias("last"), F.lit(0).cast("long").alias("k"), F.array().cast("array<struct<slot:bigint,s:bigint,e:bigint>>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        want = F.greatest(F.col("_intro"), F.call_function("div", d * c, F.lit(100)) - F.call_function("div", F.col("_size"), F.lit(2)))
        s = F.least(F.greatest(a["last"] + rest, want), late)
        e = F.least(d - F.col("_outro"), s + F.col("_size"))
        k = (a["k"] + 1).cast("long")
        taken = F.struct(e.cast("long").alias("last"), k.alias("k"), F.concat(a["out"], F.array(F.struct(k.alias("slot"), s.cast("long").alias("s"), e.cast("long").alias("e")))).alias("out"))
        return F.when(e - s >= least, taken).otherwise(F.struct(a["last"].alias("last"), k.alias("k"), a["out"].alias("out")))

    out = out.withColumn("_ai", F.aggregate("_at", start, step)["out"])
    beat = lambda kind, slot, s, e, notes: F.struct(F.lit(kind).alias("kind"), slot.cast("long").alias("slot"), s.cast("long").alias("beat_start"), e.cast("long").alias("beat_end"), F.lit(notes).alias("notes"))
    zero = F.lit(0)
    # the original before each insert: from the end of the one before
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("_ai", lambda x: x["e"]))
    out = out.withColumn("_pairs", F.arrays_zip(F.col("_ai").alias("ai"), F.slice(ends, 1, F.greatest(F.size("_ai"), F.lit(0))).alias("from")))
    gaps = F.filter(F.transform("_pairs", lambda p: beat("original", zero, p["from"], p["ai"]["s"], "original_segment")), lambda b: b["beat_end"] - b["beat_start"] >= gap)
    own = F.transform("_ai", lambda x: beat("stock_video", x["slot"], x["s"], x["e"], "insert"))
    tail = F.filter(F.array(beat("original", zero, F.element_at(F.col("_ai"), -1)["e"], d, "original_outro")), lambda b: b["beat_end"] - b["beat_start"] >= gap)
    whole = F.array(F.when(F.col("_n") <= 0, beat("original", zero, zero, d, "full_original")).otherwise(beat("original", zero, zero, d, "fallback_original_only")))
    beats = F.when(F.size("_ai") > 0, F.concat(own, gaps, F.when(F.size("_ai") > 0, tail))).otherwise(whole)
    long_enough = F.filter(beats, lambda b: b["beat_end"] - b["beat_start"] > shortest)
    return out.select(*keys, length, F.inline(long_enough))


def islands(rows: DataFrame, keys: Sequence[str], start: str, end: str, name: str = "island") -> DataFrame:
    """Add the number of a row's island: rows of a key, by ``start``, between which no earlier row reaches.

    What happens in one island doesn't touch another, so a fold may take them one by one.
    """
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0)
    return rows.withColumn("_fresh", fresh).withColumn(name, F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def tile_accepted(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-to-right tiling where a place without a window is passed over. windows: keys, idx, size, one at most for a place.

    A window is taken if no taken one reaches beyond its start. Windows that no other reaches into begin a fold of their
    own, so a state is as small as a chain of overlapping windows, not as a key's rows.
    """
    spread = islands(windows.withColumn("_to", F.col("idx") + F.col("size")), keys, "idx", "_to")
    start = F.struct(F.lit(None).cast("long").alias("next"), F.array().cast("array<struct<idx:bigint,size:bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        here = F.struct((x["idx"] + x["size"]).cast("long").alias("next"), F.concat(a["out"], F.array(F.struct(x["idx"].cast("long").alias("idx"), x["size"].cast("long").alias("size")))).alias("out"))
        return F.when(a["next"].isNull() | (x["idx"] >= a["next"]), here).otherwise(a)

    out = ordered_fold(spread, [*keys, "island"], [F.col("idx")], ["idx", "size"], start, step)
    return out.select(*keys, F.explode("state.out").alias("r")).select(*keys, "r.*")
