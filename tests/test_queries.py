"""Every query with an oracle gives the oracle's rows."""

import pytest

from timbrel.queries import ORACLES, QUERIES

from .conftest import SF, canonical


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    want = canonical([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_history_stream_counts_equal_batch(spark):
    from pyspark.sql import functions as F

    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").count()
    got = {(str(r.hour), r.event_type): r.n for r in QUERIES["history_stream"](spark, SF).collect()}
    assert got == {(str(r.hour), r.event_type): r["count"] for r in batch.collect()}
