"""URL filter: host rules, then a weighted vocabulary searched by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, ship

#: Weight of distinct hits from which a URL is rejected.
LIMIT = 2
#: Terms by weight: one strict term reaches the limit, of soft ones it takes several.
STRICT = (
    "adult-x", "ads-track", "blackjack", "camgirls", "casino", "cheap-pills", "cialis", "free-bets", "hardcore-video", "jackpot", "online-pharmacy", "payday-loan",
    "porn", "pornstar", "sexcam", "slot-machine", "spam-farm", "sportsbook", "viagra", "xxx",
)
SOFT = (
    "ads", "adult", "affiliate", "babes", "bet", "bets", "betting", "bonus", "cam", "cheap", "clickbait", "coupon", "dating", "deals", "escort", "farm", "free", "gamble", "hot",
    "loan", "lottery", "nude", "pills", "poker", "promo", "sex", "slots", "spam", "torrent", "track", "win", "xx",
)
VOCABULARY = {**dict.fromkeys(SOFT, 1), **dict.fromkeys(STRICT, LIMIT)}
#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
    ("block", "example.org", "/en/1"),
)


@lru_cache(maxsize=8)
def _automaton(terms: tuple[tuple[str, int], ...]):
    a = ahocorasick.Automaton()
    for w, weight in terms:
        a.add_word(w, (w, weight))
    if len(a):
        a.make_automaton()
    return a


def _edge(c: str) -> bool:
    return not (c.isascii() and c.isalnum())


def weigh_terms(low: str | None, terms: tuple[tuple[str, int], ...], limit: int) -> tuple[int, int, int]:
    """Distinct strict terms (of the limit's weight), soft ones, and their weight together, of a folded URL.

    A term counts where it stands between boundaries: no ASCII letter or digit is beside it.
    """
    a = _automaton(terms)
    if not low or not len(a):
        return 0, 0, 0
    seen: set[tuple[str, int]] = set()
    for end, hit in a.iter(low):
        start = end - len(hit[0]) + 1
        if (start == 0 or _edge(low[start - 1])) and (end + 1 == len(low) or _edge(low[end + 1])):
            seen.add(hit)
    strict = sum(w >= limit for _, w in seen)
    return strict, len(seen) - strict, sum(w for _, w in seen)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, vocabulary: Mapping[str, int] = VOCABULARY, limit: int = LIMIT, key: str = "page_id", url: str = "url") -> DataFrame:
    """Judge each row's URL: key, host, path, rule, verdict, n_strict, n_soft, weight.

    The longest fitting rule decides (ties: the first given); a rule fits its host and all
    subdomains if the path starts with the rule's. Without a rule, distinct terms of the
    ``vocabulary`` (lower-case term: weight) that together weigh ``limit`` block. Terms are matched
    on the whole URL, however long, A-Z folded, and count only between boundaries. A null or
    malformed URL has empty host and path, fits no rule, and null holds no term, so it is
    allowed. Repeated rows are judged each; other columns aren't read; an empty table gives
    none. One map step; nothing is shuffled.
    """
    ship(pages.sparkSession)
    listed = tuple(sorted(vocabulary.items()))

    @F.pandas_udf("n_strict int, n_soft int, weight int")
    def terms(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in urls:
            yield pd.DataFrame([weigh_terms(u, listed, limit) for u in s], columns=["n_strict", "n_soft", "weight"], dtype="int32")

    host, path = host_and_path(F.col("_url"))
    df = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")).select("_key", "_url", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first
        fits = (F.col("host") == h) | F.col("host").endswith("." + h)
        fits = fits & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    df = df.withColumn("_t", terms(ascii_lower(F.col("_url"))))
    own = F.when(F.col("_t.weight") >= limit, "block").otherwise("allow")
    return df.select(
        F.col("_key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        F.col("_t.n_strict").alias("n_strict"), F.col("_t.n_soft").alias("n_soft"), F.col("_t.weight").alias("weight"),
    )


def _sql() -> str:
    esc = lambda w: w.replace("-", "\\-")
    hit = lambda w: f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){esc(w)}($|[^a-z0-9])') THEN 1 ELSE 0 END"
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in rules) + " WHEN 2 * n_strict + n_soft >= 2 THEN 'block' ELSE 'allow' END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH a AS (
  SELECT page_id, coalesce(url, '') AS url,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
         translate(coalesce(url, ''), '{upper}', '{lower}') AS low
  FROM pages
), b AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM a
), c AS (
  SELECT *, CAST({" + ".join(map(hit, STRICT))} AS INTEGER) AS n_strict, CAST({" + ".join(map(hit, SOFT))} AS INTEGER) AS n_soft FROM b
)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, n_strict, n_soft, CAST(2 * n_strict + n_soft AS INTEGER) AS weight FROM c
"""


def _query(spark, sf_dir):
    from .common import table

    return url_filter(table(spark, sf_dir, "pages"))


QUERIES = {"op2_url_filter": _query}
ORACLES = {"op2_url_filter": _sql()}
