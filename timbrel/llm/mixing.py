"""Mix sources to target weights with hash-threshold histograms.

No row is sorted. Sizes are summed by (source, hash bucket); the bucket in which a source's
budget runs out is refined by the next bits of the hash, until one hash value is left. Cuts are
nested: a larger budget keeps every document that a smaller one keeps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, ranked, settle, table, unused

#: Bits of the hash, and bits refined at a time.
HASH_BITS, LEVEL_BITS = 60, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column) -> Column:
    """60 bits of md5 of the id as text; null counts as an empty text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], total_percent: int, cap_percent: int) -> DataFrame:
    """source, source_size, target: shares by weight, capped, the excess dealt again until none is above.

    Which sources are capped is found by rounds over the table of sources, whose sums alone
    reach the driver, as whole numbers.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    per = ranked(per, order, "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", weight.cast("decimal(38,0)").alias("w"))
    size = F.col("source_size").cast("decimal(38,0)")
    whole = per.agg(F.sum(size)).first()[0]
    whole = int(whole or 0)
    num, den, capped = total_percent * whole, None, F.lit(False)
    seen = -1
    while True:
        a = per.agg(
            F.sum(F.when(capped, size).otherwise(0)).alias("s"), F.sum(F.when(capped, 0).otherwise(F.col("w"))).alias("w"), F.count_if(capped).alias("n")
        ).first()
        num, den = total_percent * whole - cap_percent * int(a["s"] or 0), int(a["w"] or 0)
        if a["n"] == seen or not den:
            break
        seen = a["n"]
        # a source once above its cap stays so, as what is left for the others only grows
        capped = capped | (F.col("w") * F.expr(f"CAST('{num}' AS DECIMAL(38,0))") > size * F.expr(f"CAST('{cap_percent * den}' AS DECIMAL(38,0))"))
    cap = (F.col("source_size") * cap_percent).cast("double") / 100.0
    share = (F.col("w") * F.expr(f"CAST('{num}' AS DECIMAL(38,0))")).cast("double") / float(100 * den) if den else F.lit(0.0)
    return per.select("source", "source_size", F.when(capped, cap).otherwise(share).alias("target"))


def mix_plan(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), total_percent: int = 150, cap_percent: int = 200) -> DataFrame:
    """source, source_size, target, times, cut: each document is taken ``times`` times, and once more if its hash is at most ``cut``."""
    t = source_targets(sizes, weights, total_percent, cap_percent)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = t.withColumn("times", times).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size"))
    state = state.select("*", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("held"))
    state = settle(state, "mix-state")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        at = sizes.select(F.col("source").alias("_s"), "size", "h").join(
            state, F.col("_s").eqNullSafe(F.col("source")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        )
        hist = at.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        # at most 2^LEVEL_BITS rows of a source
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        found = hist.join(state.select(F.col("source").alias("_s"), "below", "budget"), F.col("source").eqNullSafe(F.col("_s")))
        found = found.filter(F.col("below") + F.col("upto") > F.col("budget")).groupBy("source").agg(F.min(F.struct("bucket", "n", "upto")).alias("m"))
        found = found.select(F.col("source").alias("_f"), "m")
        old, state = state, settle(
            state.join(found, F.col("source").eqNullSafe(F.col("_f")), "left").select(
                "source", "source_size", "target", "times", "budget",
                F.coalesce("m.bucket", F.lit(-1).cast("long")).alias("prefix"),
                F.coalesce(F.col("below") + F.col("m.upto") - F.col("m.n"), "below").alias("below"),
                F.coalesce("m.n", F.lit(0).cast("long")).alias("held"),
            ),
            "mix-state",
        )
        discard(old)
    fits = 2 * F.col("below") + F.col("held") <= 2 * F.col("budget")  # the last documents go in if that comes nearer
    cut = F.when(fits, F.col("prefix")).otherwise(F.col("prefix") - 1)
    # without a budget left no hash is taken once more, that of an empty document neither
    return state.select("source", "source_size", "target", "times", F.when((F.col("prefix") < 0) | (F.col("budget") <= 0), -1).otherwise(cut).alias("cut"))


def taken_times(h: Column, times: Column, cut: Column) -> Column:
    return times + F.when(h <= cut, 1).otherwise(0)


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document.

    Null text has size 0; a null source is one more source, the last. Rows of one source that
    share a doc_id share its hash and go together. Taken words of a source differ from its
    target by at most half of the words under its last hash value, as documents stay whole.
    All words of a very long text count. An empty table gives none.
    """
    sizes = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id")).alias("h")), "mix-sizes")
    plan = mix_plan(sizes.select("source", "size", "h"), **how).withColumnRenamed("source", "_p")
    both = sizes.join(plan, F.col("source").eqNullSafe(F.col("_p")))
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * taken_times(F.col("h"), F.col("times"), F.col("cut"))).alias("taken"), "source")


def mix_rows(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, each as often as the mix takes it (possibly not at all).

    A document without words adds nothing to its source; it is taken once at most. Other columns
    come along whatever their names; rows that share a doc_id and a source go together.
    """
    sizes = settle(docs.select("source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id")).alias("h")), "mix-sizes")
    of, n, cut, copy = unused(docs.columns, "mix_source", "mix_times", "mix_cut", "mix_copy")
    plan = mix_plan(sizes, **how).select(F.col("source").alias(of), F.col("times").alias(n), F.col("cut").alias(cut))
    both = docs.join(plan, F.col("source").eqNullSafe(F.col(of)))
    times = taken_times(row_hash(F.col("doc_id")), F.col(n), F.col(cut))
    times = F.when(F.coalesce(F.col("text").rlike(WORD), F.lit(False)), times).otherwise(F.least(times, F.lit(1)))
    copies = F.explode(F.array_repeat(F.lit(0), times.cast("int")))
    return both.withColumn(copy, copies).select(*docs.columns)


def plan_sql(rel: str, prefix: str = "") -> str:
    """Common table expressions that end in ``{prefix}taken`` (doc_id, ..., times) for relation ``rel``."""
    p = prefix
    return f"""
{p}sz AS (
  SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM {rel}
), {p}src AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS s,
         CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS HUGEINT) AS w
  FROM {p}sz GROUP BY source
), {p}ord AS (
  SELECT *, coalesce(sum(s) OVER o, 0) AS s0, coalesce(sum(w) OVER o, 0) AS w0, sum(s) OVER () AS st, sum(w) OVER () AS wt
  FROM {p}src WINDOW o AS (ORDER BY CAST(s AS DOUBLE) / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), {p}cap AS (
  SELECT *, w * (150 * st - 200 * s0) > 200 * s * (wt - w0) AS capped FROM {p}ord
), {p}lam AS (
  SELECT 150 * max(st) - 200 * coalesce(sum(CASE WHEN capped THEN s END), 0) AS num, 100 * coalesce(sum(CASE WHEN NOT capped THEN w END), 0) AS den FROM {p}cap
), {p}tgt AS (
  SELECT source, CAST(s AS BIGINT) AS source_size,
         CASE WHEN capped THEN CAST(200 * s AS DOUBLE) / 100.0 WHEN den = 0 THEN 0.0 ELSE CAST(w * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target
  FROM {p}cap, {p}lam
), {p}bud AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM {p}tgt
), {p}grp AS (
  SELECT source, h, sum(size) AS g FROM {p}sz GROUP BY source, h
), {p}run AS (
  SELECT source, h, g, sum(g) OVER (PARTITION BY source ORDER BY h) - g AS before FROM {p}grp
), {p}taken AS (
  SELECT z.*, b.source_size, b.target,
         b.times + CASE WHEN b.source_size > 0 AND 2 * r.before + r.g <= 2 * (b.target - b.times * b.source_size) THEN 1 ELSE 0 END AS times
  FROM {p}sz z JOIN {p}bud b ON z.source IS NOT DISTINCT FROM b.source
  JOIN {p}run r ON r.source IS NOT DISTINCT FROM z.source AND r.h = z.h
)"""


def _query(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op1_mixing": _query}
ORACLES = {
    "op1_mixing": "WITH " + plan_sql("documents") + " SELECT doc_id, size, source_size, target, CAST(size * times AS BIGINT) AS taken, source FROM taken"
}
