"""Which terms set a source apart from its language, and how far sources of a language diverge.

Plain relational steps: regular-expression matches are exploded and counted by group (language and
source), groups are crossed with their language's kept vocabulary so that zeros count, and the
dense table is joined with itself on language and term. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, settle, table

#: A term is a run of ASCII letters and of anything beyond ASCII; this is what lies between terms.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Probabilities are whole numbers of this unit.
UNIT = 1_000_000_000
#: Counts below this times UNIT fit a long.
FITS = 9_000_000_000
#: A language's vocabulary is dealt to so many keys when it meets the language's groups.
SALTS = 32


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents), in one pass.

    A text's matches, here what lies between the gaps, are sorted, so that the first of equal ones can be told
    by the one before it; counting documents then needs no shuffle of documents.
    """
    text = ascii_lower(F.coalesce("text", F.lit("")))
    words = docs.select(*_groups_of(docs), F.sort_array(F.split(text, GAP)).alias("t"))
    beside = words.select("lang", "source", F.explode(F.arrays_zip("t", F.concat(F.array(F.lit("")), "t").alias("before"))).alias("z"))
    one = beside.filter("z.t <> ''").select("lang", "source", F.col("z.t").alias("term"), (F.col("z.t") != F.col("z.before")).cast("long").alias("first"))
    return one.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum("first").alias("d"))


def _groups_of(docs: DataFrame) -> list[Column]:
    return [F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source")]


def probability(n: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + vocabulary)); in decimals where the product doesn't fit a long."""
    wide = _div(F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + vocabulary).cast("decimal(20,0)"))
    return 1 + F.when(n < FITS, _div(F.lit(UNIT).cast("long") * (n + 1), total + vocabulary)).otherwise(wide)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); at most UNIT^2, so a long holds it."""
    return _div((p - q) * (p - q), q)


def source_audit(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has every other source of the language, part ``term`` the ``top`` terms.

    Null text, language and source are read as ''. Each row is a document, repeated rows and ids
    too. A group without terms counts zeros; a language without a kept term has pairs of value 0.
    Whole texts count, however long. Ties rank by item, bytes ascending. An empty table gives none.
    Rows on the way grow with kept terms times squared sources of a language. A value is below
    (UNIT + kept terms)^2, which a long holds up to two billion kept terms.
    """
    by_term = term_counts(docs).groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("all_n"), F.collect_list(F.struct("source", "n")).alias("counts"))
    vocabulary = settle(by_term.filter(F.col("d") >= least_docs).select("lang", "term", "all_n", "counts"), "audit-vocabulary")
    kept = vocabulary.select("lang", "term", "all_n", F.inline("counts"))
    groups = docs.select(*_groups_of(docs)).distinct()
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.join(vocabulary.groupBy("lang").agg(F.sum("all_n").alias("all_total"), F.count("*").alias("v")), "lang", "left")
    groups = settle(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "all_total", "v")]), "audit-groups")
    return pairs(vocabulary, groups).unionByName(terms(kept, groups, top)).select("lang", "source", "part", "item", "value", "rank")


def dense(vocabulary: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, term, source, p: every group with every kept term of its language.

    A term's counts, no more than its language has sources, come along, so that zeros need no second join.
    """
    salted = vocabulary.select("lang", "term", F.map_from_entries("counts").alias("n"), F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int").alias("salt"))
    dealt = groups.select("lang", "source", "total", "v", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    n = F.coalesce(F.element_at("n", F.col("source")), F.lit(0).cast("long"))
    return salted.join(dealt, ["lang", "salt"]).select("lang", "term", "source", probability(n, F.col("total"), F.col("v")).alias("p"))


def pairs(vocabulary: DataFrame, groups: DataFrame) -> DataFrame:
    """Part ``pair``: the sum of divergences over all kept terms, for each other source. Two groups meet once, for both directions."""
    a = settle(dense(vocabulary, groups), "audit-dense")
    b = a.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    both = a.join(b, ["lang", "term"]).filter(F.col("source") < F.col("item"))
    sums = both.groupBy("lang", "source", "item").agg(F.sum(divergence(F.col("p"), F.col("q"))).alias("there"), F.sum(divergence(F.col("q"), F.col("p"))).alias("back"))
    ways = F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    found = sums.select("lang", F.inline(ways))
    bare = groups.filter("v = 0").select("lang", "source")
    none = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").filter(F.col("source") != F.col("item")).withColumn("value", F.lit(0).cast("long"))
    return found.unionByName(none).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(_order()))


def terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """Part ``term``: terms of a group that are likelier in it than in its language, the ``top`` first."""
    both = kept.join(groups, ["lang", "source"])
    p, q = probability(F.col("n"), F.col("total"), F.col("v")), probability(F.col("all_n"), F.col("all_total"), F.col("v"))
    both = both.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    both = both.select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"), F.lit("term").alias("part"))
    return both.withColumn("rank", F.row_number().over(_order())).filter(F.col("rank") <= top)


def _order() -> Window:
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")


def _query(spark, sf_dir):
    return source_audit(table(spark, sf_dir, "documents"))


QUERIES = {"op11_source_divergence": _query}
ORACLES = {
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), t AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), vocab AS (
  SELECT lang, term, count(*) AS all_n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3
), cnt AS (
  SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term
), grp AS (
  SELECT DISTINCT lang, source FROM d
), tot AS (
  SELECT lang, count(*) AS v, sum(all_n) AS all_total FROM vocab GROUP BY lang
), dense AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, v.all_n,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, t.v, t.all_total
  FROM grp g JOIN vocab v ON v.lang = g.lang JOIN tot t ON t.lang = g.lang
  LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), pq AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v) AS p, 1 + (1000000000::HUGEINT * (all_n + 1)) // (all_total + v) AS q FROM dense
), pr AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM pq a JOIN pq b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), allpairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pr p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM allpairs
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM pq WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
  FROM parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""
}
