"""Quality rules: text statistics, and robust multivariate outliers among them.

For each language and source the minimum-covariance-determinant estimate of the statistics is
searched by concentration steps from two deterministic starts. A document far from its group by
Mahalanobis distance is rejected. DataFrame functions only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settle, table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Base limits: fewest words, and the largest share of words in repeated windows (per cent).
MIN_WORDS, MAX_REPEAT = 50, 50
#: Part of a group that a concentration step keeps; least rows for a group's own estimate.
PART, MIN_GROUP = 0.75, 60
#: Steps end when no group's log determinant falls by as much (the bins let it wander by about 0.04); their number at most.
SETTLED, STEPS = 0.05, 10
#: Share of normal data beyond the limit of distance, and the factor that allows for tails heavier than normal.
TAIL, TAIL_FACTOR = 1e-6, 2.5
#: Standard deviation that a transformed statistic has at least.
FLOORS = (0.15, 0.25, 0.06, 0.06, 0.06)
P = len(FLOORS)


def _chi2_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma function by its series."""
    if x <= 0:
        return 0.0
    a, z = k / 2.0, x / 2.0
    term = total = 1.0 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, k) < p else (low, mid)
    return high


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    A window is known by a 64-bit hash of its words, compared only within one text.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*keep, t.alias("_t")).select(*keep, "_t", F.array_remove(F.split("_t", SPACE), "").alias("_w"))
    n = F.size("_w")
    window = F.transform(
        F.slice("_w", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i"))
    )
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        F.sort_array(window).alias("_s"),
    )
    same = lambda x, i: (F.get("_s", i - 1)["h"] == x["h"]) | (F.get("_s", i + 1)["h"] == x["h"])
    twice = F.sort_array(F.transform(F.filter("_s", same), lambda x: x["i"]))
    df = df.select(*keep, "n_words", "word_chars", "n_symbols", F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), twice.alias("_p"))
    spans = F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3))))
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def transformed() -> list[Column]:
    """Length, mean word length, and three shares under the variance-stabilising root.

    Constants in the last two denominators keep one repetition in a short text from weighing much.
    """
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.col("word_chars") / n,
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 10).cast("double")),
        F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + 100).cast("double")),
    ]


X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _with_cholesky(params: DataFrame) -> DataFrame:
    """Add l_ij (lower triangle) of the covariance c_ij, with the floors added to its diagonal, and the log determinant."""
    for i in range(P):
        cols: dict[str, Column] = {}
        for j in range(i + 1):
            s = F.col(f"c{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
            s = reduce(lambda a, k: a - (cols.get(f"l{i}{k}", F.col(f"l{i}{k}")) * (F.col(f"l{j}{k}") if j < i else cols[f"l{i}{k}"])), range(j), s)
            if i == j:
                cols[f"l{i}{j}"] = F.sqrt(F.greatest(s, F.lit(FLOORS[i] ** 2 / 4)))
            else:
                params = params.withColumn(f"l{i}{j}", s / F.col(f"l{j}{j}"))
                cols[f"l{i}{j}"] = F.col(f"l{i}{j}")
        params = params.withColumn(f"l{i}{i}", cols[f"l{i}{i}"])
    return params.withColumn("logdet", reduce(lambda a, b: a + b, [2 * F.log(f"l{i}{i}") for i in range(P)]))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    y: list[Column] = []
    for i in range(P):
        s = F.col(X[i]) - F.col(f"m{i}")
        for j in range(i):
            s = s - F.col(f"l{i}{j}") * y[j]
        y.append(s / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, [v * v for v in y])


KEY = ["level", "g_lang", "g_source"]


def _join(rows: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    p = params.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in params.columns if c not in keys])
    return rows.join(p, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])).drop(*[f"_{k}" for k in keys])


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and covariance of each group."""
    a = rows.groupBy(*keys).agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(X)], *[F.covar_pop(X[i], X[j]).alias(f"c{i}{j}") for i, j in PAIRS], F.count("*").alias("n"))
    return a


def mcd(rows: DataFrame) -> DataFrame:
    """KEY, m_i, l_ij: centre and Cholesky factor of each group's estimate; rows: KEY and x_i.

    A group's part of nearest rows is cut by counts over bins of the distance's logarithm, so
    nothing but sums is ever gathered for a group, however large. Steps from both starts go on
    until no group's determinant falls any more; only the largest fall reaches the driver.
    """
    keys = [*KEY, "start"]
    med = rows.groupBy(*KEY).agg(*[F.percentile_approx(x, F.lit(0.5), 2000).alias(f"m{i}") for i, x in enumerate(X)], F.count("*").alias("n"))
    dev = _join(rows, med, KEY).groupBy(*KEY).agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(P)],
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), F.lit(0.5), 2000).alias(f"d{i}") for i, x in enumerate(X)],
        F.count("*").alias("n"),
    )
    zero = F.lit(0.0)
    robust = dev.select(*KEY, F.lit(0).alias("start"), *[f"m{i}" for i in range(P)], *[(F.pow(F.col(f"d{i}") * 1.4826, 2) if i == j else zero).alias(f"c{i}{j}") for i, j in PAIRS], "n")
    plain = _moments(rows, KEY).select(*KEY, F.lit(1).alias("start"), *[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i, j in PAIRS], "n")
    params = settle(_with_cholesky(robust.unionByName(plain)), "mcd")
    factor = PART / _chi2_cdf(chi2_quantile(PART, P), P + 2)
    for _ in range(STEPS):
        near = _join(rows, params.select(*keys, *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS]), KEY)
        near = near.select(*keys, *X, F.floor(16 * F.log2(_distance() + 1e-6)).alias("bin"))
        run = Window.partitionBy(*keys).orderBy("bin")
        bins = near.groupBy(*keys, "bin").count()
        bins = bins.withColumn("upto", F.sum("count").over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("count").over(Window.partitionBy(*keys)))
        cut = bins.filter(F.col("upto") >= PART * F.col("all")).groupBy(*keys).agg(F.min("bin").alias("cut"))
        step = _moments(_join(near, cut, keys).filter(F.col("bin") <= F.col("cut")), keys)
        step = step.select(*keys, *[f"m{i}" for i in range(P)], *[(F.col(f"c{i}{j}") * factor).alias(f"c{i}{j}") for i, j in PAIRS], "n")
        old, params = params, settle(_with_cholesky(step), "mcd")
        fall = _join(params.select(*keys, "logdet"), old.select(*keys, F.col("logdet").alias("before")), keys).agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
        discard(old)
        if fall is None or fall < SETTLED:
            break
    best = params.groupBy(*KEY).agg(F.min_by(F.struct(*[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS]), F.struct("logdet", "start")).alias("b"))
    return best.select(*KEY, "b.*")


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    Null text counts as empty; null languages and sources are groups of their own. Documents
    that fail the base limits take no part in the estimates. A (lang, source) with under
    MIN_GROUP documents is estimated together with the other small ones of its language, and
    if these are still too few, with all such; with fewer than MIN_GROUP even then, nothing
    but the base limits judges (distance null). Every row stands for itself, repeated ones too.
    Whole texts are read, however long; only the columns named are, so others may bear any name;
    an empty table gives none.
    """
    stats = text_statistics(docs, ["doc_id", "lang", "source"])
    stats = settle(stats.select("*", base_failed().alias("base_failed"), *[c.alias(x) for c, x in zip(transformed(), X, strict=True)]), "rules-statistics")
    good = stats.filter(~F.col("base_failed"))
    sizes = good.groupBy("lang", "source").agg(F.count("*").alias("n2"))
    small = sizes.filter(F.col("n2") < MIN_GROUP)
    by_lang = small.groupBy("lang").agg(F.sum("n2").alias("n1"))
    rest = int(by_lang.filter(F.col("n1") < MIN_GROUP).agg(F.sum("n1")).first()[0] or 0)
    groups = sizes.join(by_lang.withColumnRenamed("lang", "_k"), F.col("lang").eqNullSafe(F.col("_k")), "left").drop("_k")
    level = F.when(F.col("n2") >= MIN_GROUP, 2).when(F.col("n1") >= MIN_GROUP, 1).otherwise(0 if rest >= MIN_GROUP else -1)
    groups = settle(groups.select("lang", "source", level.alias("level")), "rules-groups")
    keyed = _join(good, groups, ["lang", "source"]).filter("level >= 0")
    g_lang, g_source = F.when(F.col("level") >= 1, F.col("lang")), F.when(F.col("level") == 2, F.col("source"))
    rows = keyed.select("level", g_lang.alias("g_lang"), g_source.alias("g_source"), *X)
    model = mcd(rows)
    per = _join(groups.select("lang", "source", "level", g_lang.alias("g_lang"), g_source.alias("g_source")), model, KEY)
    per = settle(per.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS]), "rules-model")
    out = stats.join(per, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    limit = chi2_quantile(1 - TAIL, P) * TAIL_FACTOR
    return out.withColumn("distance", _distance()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)).alias("kept"), "distance",
    )


def _query(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES = {"op5_quality_rules": _query}
ORACLES: dict[str, str] = {}
