"""Inverted-index retrieval and match scores over token tables (id, pos, token)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.readers import dealt


def tokens(df: DataFrame, key: str, text: Column) -> DataFrame:
    """key, pos, token of a normalised text."""
    return df.select(key, F.posexplode(X.words(text)).alias("pos", "token"))


def document_frequency(tok: DataFrame, key: str, shortest: int = 2) -> DataFrame:
    """token, df over distinct (key, token)."""
    return tok.filter(F.length("token") >= shortest).select(key, "token").distinct().groupBy("token").agg(F.count("*").alias("df"))


def with_idf(df: DataFrame, n: int) -> DataFrame:
    """idf = 1 + ln((n + 1) / (df + 1)), rounded so that sums rank alike on every run."""
    return df.withColumn("idf", F.round(1.0 + F.log(F.lit(float(n + 1)) / (F.col("df") + 1)), 4))


#: Rows up to which a corpus's table goes to every task, so that the sources needn't move to meet it.
SMALL = 200_000


def held(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is small: counted, not guessed."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def candidates(source: DataFrame, corpus: DataFrame, idf: DataFrame, source_key: str, corpus_key: str, k: int, rarest: int = 10) -> DataFrame:
    """source_key, corpus_key, points, place: the ``k`` corpus rows that share the most weight of a source's rarest tokens.

    Points are whole ten-thousandths. Postings are joined by token; a token in very many rows
    carries little and should be left out of ``idf`` by its df.
    """
    w = Window.partitionBy(source_key).orderBy(F.desc("points4"), "token")
    points = F.round(F.col("idf") * 10000).cast("long").alias("points4")
    mine = source.select(source_key, "token").distinct().join(held(idf.select("token", points)), "token")
    mine = mine.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= rarest)
    posts = held(corpus.select(corpus_key, "token").distinct())
    both = mine.join(posts, "token").groupBy(source_key, corpus_key).agg(F.sum("points4").alias("points"))
    w = Window.partitionBy(source_key).orderBy(F.desc("points"), corpus_key)
    return both.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= k)


def bag_overlap(pairs: DataFrame, a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """pairs with common: the size of the intersection of their token bags, repeats counted."""
    ca = a.groupBy(a_key, "token").agg(F.count("*").alias("ca"))
    cb = b.groupBy(b_key, "token").agg(F.count("*").alias("cb"))
    hit = pairs.select(a_key, b_key).join(ca, a_key).join(held(cb), [b_key, "token"]).groupBy(a_key, b_key).agg(F.sum(F.least("ca", "cb")).alias("common"))
    return pairs.join(hit, [a_key, b_key], "left").withColumn("common", F.coalesce("common", F.lit(0).cast("long")))


def f1(common: Column, a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2.0 * common / (a + b)).otherwise(0.0)


def weighted_coverage(pairs: DataFrame, a: DataFrame, b: DataFrame, idf: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """pairs with matched4 and all4: weight, in ten-thousandths, of a's distinct tokens that b has, and of all; unknown tokens weigh 1."""
    w = a.select(a_key, "token").distinct().join(idf.select("token", "idf"), "token", "left").select(a_key, "token", F.round(F.coalesce("idf", F.lit(1.0)) * 10000).cast("long").alias("w"))
    whole = w.groupBy(a_key).agg(F.sum("w").alias("all4"))
    hit = pairs.select(a_key, b_key).join(w, a_key).join(b.select(b_key, "token").distinct(), [b_key, "token"]).groupBy(a_key, b_key).agg(F.sum("w").alias("matched4"))
    return pairs.join(whole, a_key).join(hit, [a_key, b_key], "left").withColumn("matched4", F.coalesce("matched4", F.lit(0).cast("long")))


def anchor_coverage(pairs: DataFrame, anchors: DataFrame, corpus: DataFrame, source_key: str, corpus_key: str) -> DataFrame:
    """pairs with matched4 and all4 (weight of the source's anchors that the row has, and of all), hits and anchors (their numbers).

    ``anchors``: see anchor_weights(). ``corpus``: its tokens. A source without anchors has zeros.
    """
    whole = anchors.groupBy(source_key).agg(F.sum("idf4").alias("all4"), F.count("*").alias("anchors"))
    hit = pairs.select(source_key, corpus_key).join(anchors, source_key).join(corpus.select(corpus_key, "token").distinct(), [corpus_key, "token"])
    hit = hit.groupBy(source_key, corpus_key).agg(F.sum("idf4").alias("matched4"), F.count("*").alias("hits"))
    both = pairs.join(whole, source_key, "left").join(hit, [source_key, corpus_key], "left")
    return both.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("matched4", "all4", "hits", "anchors")})


def anchor_bigrams(tokens: Column, common: Sequence[str], stop: Sequence[str] = ()) -> Column:
    """A source's distinct bigrams of anchors."""
    return _kept_bigrams(tokens, lambda x: (F.length(x) >= 2) & ~_any(x, [*common, *stop]))


def content_bigrams(tokens: Column, stop: Sequence[str] = ()) -> Column:
    """A candidate's distinct bigrams without stop words."""
    return _kept_bigrams(tokens, lambda x: ~_any(x, stop))


def share(part: Column, whole: Column) -> Column:
    """``part`` of ``whole``, nothing of nothing."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def bigram_coverage(a: Column, b: Column) -> Column:
    """Share of a's distinct bigrams that b has, in whole per mille; none: 0."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when(F.size(x) > 0, F.floor(1000 * F.size(F.array_intersect(x, y)) / F.size(x))).otherwise(0).cast("long")


def match_score(wo: Column, f1_: Column, bo: Column, char: Column, contains: Column, length_ratio: Column, no_anchor: Column) -> Column:
    """Weighted features, lowered for unequal lengths and for a match without any anchor, within [0, 1]."""
    s = 0.44 * wo + 0.24 * f1_ + 0.18 * bo + 0.14 * char + F.when(contains, 0.025).otherwise(0.0)
    s = s * F.when(length_ratio < 0.55, 0.88).otherwise(1.0) * F.when(no_anchor, 0.82).otherwise(1.0)
    return F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))


def accepted(score: Column, margin: Column, wo: Column, bo: Column, anchors: Column, fragment: Column, least: float, least_margin: float) -> Column:
    part = (score >= max(0.60, least)) & (anchors >= 2) & (wo >= 0.58) & ~((bo < 0.22) & (anchors < 3))
    full = ~((anchors == 0) & (wo < 0.52)) & ~((anchors < 2) & (wo < 0.60))
    return (score >= least) & (margin >= least_margin) & F.when(fragment, part).otherwise(full)


def best_and_next(scored: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """key, best (its tie key), best_score, next_score."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    r = scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2)
    pick = lambda n, c: F.max(F.when(F.col("_r") == n, F.col(c)))
    return r.groupBy(key).agg(pick(1, tie).alias("best"), pick(1, score).alias("best_score"), pick(2, score).alias("next_score"))


def fragment_starts(source: DataFrame, corpus: DataFrame, anchors: DataFrame, source_key: str, corpus_key: str) -> DataFrame:
    """source_key, corpus_key, start, hits: places of the corpus row where the source may begin, by aligned anchor tokens, one place of slack either way."""
    s = source.join(anchors.select("token"), "token", "left_semi").select(source_key, "token", F.col("pos").alias("sp"))
    c = corpus.select(corpus_key, "token", F.col("pos").alias("cp"))
    at = F.explode(F.array(*[F.col("cp") - F.col("sp") + d for d in (-1, 0, 1)]))
    hit = c.join(held(s), "token").select(source_key, corpus_key, "token", at.alias("start")).filter("start >= 0").distinct()
    return hit.groupBy(source_key, corpus_key, "start").agg(F.count("*").alias("hits"))


def common_tokens(df: DataFrame, n: int, most: float = 0.08) -> list[str]:
    """Tokens in more than ``most`` of the ``n`` rows. At most a row's mean count of distinct tokens over ``most``, so they may be collected."""
    return [r.token for r in df.filter(F.col("df") > most * n).select("token").collect()]


def anchor_weights(source: DataFrame, idf: DataFrame, key: str, common: Sequence[str], stop: Sequence[str] = ()) -> DataFrame:
    """key, token, idf4: a source's distinct anchor tokens that the corpus has. ``source``: key, tokens (an array)."""
    mine = source.select(key, F.explode(F.array_distinct("tokens")).alias("token")).filter((F.length("token") >= 2) & ~_any(F.col("token"), [*common, *stop]))
    return mine.join(held(idf.select("token", F.round(F.col("idf") * 10000).cast("long").alias("idf4"))), "token").select(key, "token", "idf4")


def _any(c: Column, items: Sequence[str]) -> Column:
    return c.isin(*items) if items else F.lit(False)


def _kept_bigrams(tokens: Column, ok) -> Column:
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    both = F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n), lambda a, b: F.when(ok(a) & ok(b), F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.filter(both, lambda x: x.isNotNull()))


def voted_candidates(source: DataFrame, corpus: DataFrame, idf: DataFrame, source_key: str, corpus_key: str, k: int, common: Sequence[str], stop: Sequence[str] = ()) -> DataFrame:
    """source_key, corpus_key, points, place: the ``k`` corpus rows with the most votes, then the nearest in length, then the lowest key.

    Both tables hold a key and ``tokens``. Votes, in hundred-thousandths: 1.8 idf of each of the ten
    rarest anchor tokens, 2.4 of each of the first eight bigrams of anchors; with fewer than 20 rows
    found also 0.35 of each of the first twelve tokens. A source without any vote gets every
    corpus row (0 points, in the order of keys, not cut at ``k``); one without tokens gets none.
    """
    posts = corpus.select(corpus_key, F.size("tokens").alias("row_size"), F.explode(F.array_distinct("tokens")).alias("term"), F.lit(False).alias("gram"))
    posts = posts.unionByName(corpus.select(corpus_key, F.size("tokens").alias("row_size"), F.explode(_kept_bigrams(F.col("tokens"), lambda x: ~_any(x, stop))).alias("term"), F.lit(True).alias("gram")))
    if posts.limit(SMALL + 1).count() <= SMALL:
        return _votes_in_place(source, corpus, posts, idf, source_key, corpus_key, k, [*common, *stop])
    source = source.filter(F.size("tokens") > 0)
    w = Window.partitionBy(source_key).orderBy(F.desc("idf4"), "token")
    rare = anchor_weights(source, idf, source_key, common, stop).withColumn("_r", F.row_number().over(w)).filter("_r <= 10")
    anchor = lambda x: (F.length(x) >= 2) & ~_any(x, [*common, *stop])
    grams = source.select(source_key, F.explode(F.slice(_kept_bigrams(F.col("tokens"), anchor), 1, 8)).alias("term"))
    votes = rare.select(source_key, F.col("token").alias("term"), (18 * F.col("idf4")).alias("vote")).unionByName(grams.withColumn("vote", F.lit(240000).cast("long")))
    posts = corpus.select(corpus_key, F.explode(F.array_distinct("tokens")).alias("term"))
    pairs = corpus.select(corpus_key, F.explode(_kept_bigrams(F.col("tokens"), lambda x: ~_any(x, stop))).alias("term"))
    found = votes.join(posts.unionByName(pairs), "term").groupBy(source_key, corpus_key).agg(F.sum("vote").alias("points"))
    first = source.select(source_key, F.slice(F.array_distinct("tokens"), 1, 12).alias("_first"))
    few = first.join(found.groupBy(source_key).agg(F.count("*").alias("_n")), source_key, "left").filter("coalesce(_n, 0) < 20")
    more = few.select(source_key, F.explode("_first").alias("term")).join(posts, "term").select(source_key, corpus_key, F.lit(35000).cast("long").alias("points"))
    found = found.unionByName(more).groupBy(source_key, corpus_key).agg(F.sum("points").alias("points"))
    sizes = source.select(source_key, F.size("tokens").alias("_a"))
    both = found.join(sizes, source_key).join(corpus.select(corpus_key, F.size("tokens").alias("_b")), corpus_key)
    w = Window.partitionBy(source_key).orderBy(F.desc("points"), F.abs(F.col("_a") - F.col("_b")), corpus_key)
    best = both.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= k).select(source_key, corpus_key, "points", "place")
    none = source.select(source_key).join(found.select(source_key), source_key, "left_anti").crossJoin(corpus.select(corpus_key))
    w = Window.partitionBy(source_key).orderBy(corpus_key)
    return best.unionByName(none.select(source_key, corpus_key, F.lit(0).cast("long").alias("points"), F.row_number().over(w).cast("long").alias("place")))


def _votes_in_place(source: DataFrame, corpus: DataFrame, posts: DataFrame, idf: DataFrame, source_key: str, corpus_key: str, k: int, skip: Sequence[str]) -> DataFrame:
    """voted_candidates() of a corpus that every task can hold: sources are read and dealt by key once, and stay there.

    Each source has a mark beside its terms, which meets no row; it is what is left of a source without any vote.
    """
    anchor = lambda x: (F.length(x) >= 2) & ~_any(x, skip)
    # a text takes less room on its way than an array; exploded as one row, so that arrays are worked out once
    s = dealt(source.select(source_key, F.array_join("tokens", " ").alias("text")), source_key).filter("text <> ''")
    s = s.select(source_key, F.explode(F.array(F.split("text", " "))).alias("tokens"))
    term = lambda t, gram, early: F.struct(t.alias("term"), F.lit(gram).alias("gram"), early.alias("early"))
    words = F.transform(F.array_distinct("tokens"), lambda t, i: term(t, False, i < 12))
    grams = F.transform(F.slice(_kept_bigrams(F.col("tokens"), anchor), 1, 8), lambda t: term(t, True, F.lit(False)))
    each = s.select(source_key, F.size("tokens").alias("size"), F.explode(F.concat(words, grams, F.array(term(F.lit(""), True, F.lit(False))))).alias("t")).select(source_key, "size", "t.*")
    mark = posts.sparkSession.range(1).select(F.lit(None).cast(dict(posts.dtypes)[corpus_key]).alias(corpus_key), F.lit(None).cast("int").alias("row_size"), F.lit("").alias("term"), F.lit(True).alias("gram"))
    posts = posts.unionByName(mark)
    weights = idf.select(F.col("token").alias("term"), F.lit(False).alias("gram"), F.round(F.col("idf") * 10000).cast("long").alias("idf4"))
    terms = posts.select("term", "gram").distinct().join(weights, ["term", "gram"], "left").withColumn("anchor", F.col("idf4").isNotNull() & anchor(F.col("term")))
    order = Window.partitionBy(source_key, "anchor").orderBy(F.desc("idf4"), "term")
    met = each.join(F.broadcast(terms), ["term", "gram"]).filter("gram OR anchor OR early").withColumn("order", F.row_number().over(order))
    strong = F.when(F.col("gram") & (F.col("term") != ""), F.lit(240_000)).when(F.col("anchor") & (F.col("order") <= 10), 18 * F.col("idf4")).otherwise(0).cast("long")
    met = met.select(source_key, "size", "term", "gram", strong.alias("strong"), F.when(F.col("early"), 35_000).otherwise(0).cast("long").alias("weak")).filter("strong > 0 OR weak > 0 OR term = ''")
    found = met.join(F.broadcast(posts), ["term", "gram"]).groupBy(source_key, "size", corpus_key, "row_size").agg(F.sum("strong").alias("strong"), F.sum("weak").alias("weak"))
    whole = Window.partitionBy(source_key)
    found = found.withColumn("few", F.count_if(F.col("strong") > 0).over(whole) < 20).withColumn("points", F.col("strong") + F.when(F.col("few"), F.col("weak")).otherwise(0))
    found = found.withColumn("none", F.max("points").over(whole) == 0).filter(F.col("none") | (F.col("points") > 0)).filter(~F.col("none") | F.col(corpus_key).isNull())
    best = Window.partitionBy(source_key).orderBy(F.desc("points"), F.abs(F.col("size") - F.col("row_size")), corpus_key)
    found = found.withColumn("place", F.row_number().over(best).cast("long")).filter(F.col("place") <= k)
    rows = corpus.select(F.lit(True).alias("none"), F.col(corpus_key).alias("_row"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(corpus_key)).cast("long").alias("_place"))
    both = found.join(F.broadcast(rows), "none", "left")
    return both.select(source_key, F.when(F.col("none"), F.col("_row")).otherwise(F.col(corpus_key)).alias(corpus_key), "points", F.when(F.col("none"), F.col("_place")).otherwise(F.col("place")).alias("place"))
