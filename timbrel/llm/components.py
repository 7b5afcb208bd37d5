"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def connected_components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(id, comp) for each vertex of edges (a, b): comp is the component's smallest id.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Both take minima by
    key, which combine before the shuffle; the joins back are plain, so skewed ones are split.
    """
    e = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v"), what)
    old = [e]
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        large = settle(large.distinct(), what)
        discard(*old)
        # each vertex now points down only: its smaller neighbours meet at the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("k"), "m", "n")
        if low.filter("n > 1").isEmpty() and large.join(large.select(F.col("u").alias("k")), F.col("v") == F.col("k"), "left_semi").isEmpty():
            e = large  # every vertex has one neighbour, which has none below: stars
            break
        small = large.join(low.select("k", "m"), F.col("u") == F.col("k")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(small.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), what)
        discard(large)
        old = [e]
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("comp"))
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("comp")).unionByName(roots)
