"""How filters of a corpus act on one another: every order of five filters, step by step.

Each document becomes five failure flags. Documents are counted by part and flags, which leaves at
most 32 rows a part; SQL CUBE over the flags and the part then has, in the grouping sets whose
chosen flags are all false, the survivors of every subset of filters. A step of an order is a pair of
subsets, before and after it, so all orders are answered by joining pairs of subsets.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, settle, table

FILTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")


def text_flags(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions that a text decides alone; ``words`` is the array of its words."""
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """part, A-E, good, toxic of every document, and the settled tables that it reads.

    Texts are compared by their SHA-256. The first id of each text that occurs twice is written
    before the join, so that a text with very many copies can be split there. A null id is
    neither smaller nor larger than another, so its document doesn't fail E. Labels of an id are taken
    together: good if any row has quality 1, toxic if any has toxic 1.
    """
    text = F.coalesce("text", F.lit(""))
    words = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    facts = words.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in text_flags(F.col("text"), F.col("words")).items()])
    facts = settle(facts, "filter-facts")
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "first")
    first = settle(first, "filter-first")
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = settle(marks, "filter-labels")
    both = facts.join(first, "digest", "left").join(marks, "doc_id", "left")
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E")
    return both.select("part", "A", "B", "C", "D", late, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")]), [facts, first, marks]


def survivors(cells: DataFrame) -> DataFrame:
    """part, chosen (bits, A is 1), n, good, toxic: documents that no chosen filter fails; zeros included."""
    cube = cells.cube(*FILTERS, "part").agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping("part").alias("whole"), *[F.grouping(f).alias(f"out_{f}") for f in FILTERS])
    passing = cube.filter("whole = 0")
    for f in FILTERS:
        passing = passing.filter((F.col(f"out_{f}") == 1) | ~F.col(f))
    chosen = sum((1 - F.col(f"out_{f}")) * (1 << i) for i, f in enumerate(FILTERS))
    passing = passing.select("part", chosen.cast("int").alias("chosen"), *COUNTS)
    subsets = cells.select("part").distinct().withColumn("chosen", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))))
    return subsets.join(passing, ["part", "chosen"], "left").select("part", "chosen", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS])


def steps(spark) -> DataFrame:
    """filter_order, step, bit (of the step's filter), chosen (bits of the filters before it): a row for each step of each order."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            rows.append(("".join(order), step, bit, before))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, chosen int")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Every row is a document, repeated rows and ids too; null text is empty, null language the part ''.
    Words of whole texts count, however long. An empty table has no parts and gives none.
    """
    spark = docs.sparkSession
    flags, read = flagged(docs, labels)
    cells = settle(flags.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")), "filter-cells")
    discard(*read)
    left = settle(survivors(cells), "filter-survivors")
    discard(cells)
    everything = (1 << len(FILTERS)) - 1
    # a pair of subsets for each filter that may come next: 80 a part
    bits = F.array(*[F.lit(1 << i) for i in range(len(FILTERS))])
    before = left.select("part", "chosen", *[F.col(c).alias(f"{c}_0") for c in COUNTS], F.explode(bits).alias("bit")).filter(F.col("chosen").bitwiseAND(F.col("bit")) == 0)
    after = left.select("part", F.col("chosen").alias("then"), *COUNTS)
    pair = before.withColumn("then", F.col("chosen").bitwiseOR(F.col("bit"))).join(after, ["part", "then"])
    pair = pair.select("part", "chosen", "bit", F.col("n").alias("kept"), *[(F.col(f"{c}_0") - F.col(c)).alias(f"lost_{c}") for c in COUNTS])
    pair = settle(pair, "filter-pairs")
    fails = pair.filter("chosen = 0").select("part", "bit", F.col("lost_n").alias("fails"))
    alone = pair.filter(F.col("chosen") + F.col("bit") == everything).select("part", "bit", F.col("lost_n").alias("unique_fails"))
    # 600 rows, whatever the input
    every = pair.join(F.broadcast(steps(spark)), ["chosen", "bit"]).join(fails, ["part", "bit"]).join(alone, ["part", "bit"])
    orders = Window.partitionBy("part", "bit")
    return every.select(
        "part", "filter_order", "step", "kept", F.col("lost_n").alias("removed"), (F.col("fails") - F.col("lost_n")).alias("redundant"), "unique_fails",
        F.col("lost_good").alias("good_lost"), F.col("lost_toxic").alias("toxic_lost"), F.sum("lost_n").over(orders).alias("shapley"),
    )


def _query(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op12_filter_interaction": _query}
ORACLES = {
    "op12_filter_interaction": r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > first THEN 16 ELSE 0 END AS failing,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
), cells AS (
  SELECT part, failing, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failing
), five AS (
  SELECT substr('ABCDE', i + 1, 1) AS f, 1 << i AS bit FROM (SELECT unnest(range(5))::INT AS i)
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM five a, five b, five c, five d, five e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, (SELECT unnest(range(1, 6))::INT AS step)
), counted AS (
  SELECT c.part, s.filter_order, s.step, s.bit,
    sum(CASE WHEN c.failing & (s.before | s.bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN c.failing & s.before = 0 AND c.failing & s.bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN c.failing & s.before <> 0 AND c.failing & s.bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN c.failing = s.bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN c.failing & s.before = 0 AND c.failing & s.bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN c.failing & s.before = 0 AND c.failing & s.bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells c, steps s GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted"""
}
