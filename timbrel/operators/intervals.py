"""Joins and windows over timed segments. Every range condition stands beside an equality, so no join is nested-loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_pairs(seg: DataFrame, shortest: int, longest: int, key: str = "doc_id") -> DataFrame:
    """key, start_idx, end_idx, start_c, end_c of all runs of segments whose length lies in [shortest, longest].

    Time is cut into buckets of ``longest``: a run ends in the bucket of its start or the next
    one, so a document's segments meet by (document, bucket) rather than all with all.
    """
    a = seg.select(key, F.col("idx").alias("start_idx"), "start_c", F.explode(F.array(F.floor(F.col("start_c") / longest), F.floor(F.col("start_c") / longest) + 1)).alias("bucket"))
    b = seg.select(F.col(key).alias("_key"), F.col("idx").alias("end_idx"), "end_c", F.floor(F.col("end_c") / longest).alias("_bucket"))
    near = (F.col(key) == F.col("_key")) & (F.col("bucket") == F.col("_bucket"))
    length = F.col("end_c") - F.col("start_c")
    return a.join(b, near & (F.col("end_idx") >= F.col("start_idx")) & length.between(shortest, longest)).select(key, "start_idx", "end_idx", "start_c", "end_c")


def overlapping(clips: DataFrame, seg: DataFrame, key: str = "doc_id") -> DataFrame:
    """clips with the segments that overlap them, borders excluded: + idx, seg_start, seg_end, text."""
    s = seg.select(F.col(key).alias("_key"), "idx", F.col("start_c").alias("seg_start"), F.col("end_c").alias("seg_end"), "text")
    return clips.join(s, (F.col(key) == F.col("_key")) & (F.col("seg_end") > F.col("start_c")) & (F.col("seg_start") < F.col("end_c"))).drop("_key")


def padded(clips: DataFrame, seg: DataFrame, clip_key: Sequence[str], pad: int, key: str = "doc_id") -> DataFrame:
    """clip_key, idx, text, inside: overlapping segments and ``pad`` more on either side."""
    span = overlapping(clips, seg, key).groupBy(*clip_key).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    s = seg.select(F.col(key).alias("_key"), "idx", "text")
    both = span.join(s, (F.col(key) == F.col("_key")) & F.col("idx").between(F.col("lo") - pad, F.col("hi") + pad))
    return both.select(*clip_key, "idx", "text", F.col("idx").between(F.col("lo"), F.col("hi")).alias("inside"))


def as_of(points: DataFrame, seg: DataFrame, key: str = "doc_id", at: str = "t") -> DataFrame:
    """points with ``first_idx``, the first segment that ends after t (else the last), and ``last_idx``, the last that starts before it (else 0).

    One pass per document: points and segments are merged by time and carried along, so no
    point meets all segments. Segments must not go back in time.
    """
    p = points.select("*", F.lit(1).alias("_point"))
    s = seg.select(F.col(key), F.col("idx").alias("_idx"), F.col("start_c").alias("_start"), F.col("end_c").alias("_end"))
    started = s.select(key, F.col("_start").alias(at), F.col("_idx").alias("_s"), F.lit(None).cast("long").alias("_e"))
    ended = s.select(key, F.col("_end").alias(at), F.lit(None).cast("long").alias("_s"), F.col("_idx").alias("_e"))
    marks = started.unionByName(ended).withColumn("_point", F.lit(0))
    every = p.unionByName(marks, allowMissingColumns=True)
    back = Window.partitionBy(key).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(key).orderBy(at).rangeBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(key)
    every = every.withColumns({"last_idx": F.coalesce(F.max("_s").over(back), F.lit(0).cast("long")), "first_idx": F.coalesce(F.min("_e").over(ahead), F.max("_e").over(whole), F.lit(0).cast("long"))})
    return every.filter("_point = 1").drop("_s", "_e", "_point")


def clamp_words(clips: DataFrame, words: DataFrame, key: str = "doc_id", shortest: int = 0) -> DataFrame:
    """Words that overlap a clip, clamped to it and counted from its start."""
    w = words.select(F.col(key).alias("_key"), "word", F.col("start_c").alias("_s"), F.col("end_c").alias("_e"))
    both = clips.join(w, (F.col(key) == F.col("_key")) & (F.col("_e") > F.col("start_c")) & (F.col("_s") < F.col("end_c")))
    low, high = F.greatest("_s", "start_c") - F.col("start_c"), F.least("_e", "end_c") - F.col("start_c")
    return both.select(*clips.columns, "word", low.alias("word_start"), high.alias("word_end")).filter(F.col("word_end") - F.col("word_start") > shortest)


def time_chunks(lengths: DataFrame, size: int, overlap: int, key: str = "doc_id", length: str = "length") -> DataFrame:
    """key, chunk, keep_start, keep_end, extract_start, extract_end: chunks of ``size`` that read ``overlap`` more on either side."""
    if overlap >= size:
        raise ValueError("the overlap must be shorter than a chunk")
    n = F.ceil(F.col(length) / size).cast("long")
    df = lengths.filter(F.col(length) > 0).select(key, length, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    low, high = F.col("chunk") * size, F.least((F.col("chunk") + 1) * size, F.col(length))
    return df.select(key, "chunk", low.alias("keep_start"), high.alias("keep_end"), F.greatest(low - overlap, F.lit(0)).alias("extract_start"), F.least(high + overlap, F.col(length)).alias("extract_end"))


def owned_by_midpoint(rows: DataFrame) -> DataFrame:
    """Rows (start_c, end_c, keep_start, keep_end, last_chunk) whose midpoint lies in the kept range of their own chunk; the last chunk has no upper end."""
    twice = F.col("start_c") + F.col("end_c")
    return rows.filter((twice >= 2 * F.col("keep_start")) & (F.col("last_chunk") | (twice < 2 * F.col("keep_end"))))


def count_windows(seg: DataFrame, size: int, stride: int, key: str = "doc_id") -> DataFrame:
    """key, win, lo, hi: runs of ``size`` segments, ``stride`` apart; the last may be short."""
    n = seg.groupBy(key).agg(F.count("*").alias("n"))
    wins = F.when(F.col("n") <= size, F.lit(0)).otherwise(F.ceil((F.col("n") - size) / stride)).cast("long")
    df = n.select(key, "n", F.explode(F.sequence(F.lit(0).cast("long"), wins)).alias("win"))
    return df.select(key, "win", (F.col("win") * stride).alias("lo"), (F.least(F.col("win") * stride + size, F.col("n")) - 1).alias("hi"))


def neighbours(seg: DataFrame, key: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy("idx")
    return seg.withColumns({"prev_text": F.lag("text", 1, "").over(w), "next_text": F.lead("text", 1, "").over(w)})


def shift_grid(clips: DataFrame, back: tuple[int, int], ahead: tuple[int, int], last: Column, unique: bool = True) -> DataFrame:
    """clips with every shifted (s, e) of their start and end, clamped to [0, last], end not before start."""
    s = F.greatest(F.lit(0), F.least(last, F.col("start_idx") + F.col("_ds")))
    e = F.greatest(F.lit(0), F.least(last, F.col("end_idx") + F.col("_de")))
    df = clips.withColumn("_ds", F.explode(F.sequence(F.lit(back[0]), F.lit(back[1])))).withColumn("_de", F.explode(F.sequence(F.lit(ahead[0]), F.lit(ahead[1]))))
    df = df.select(*clips.columns, s.alias("s"), e.alias("e")).filter("e >= s")
    return df.distinct() if unique else df
