"""Contiguous shards of nearly equal bytes from global prefix sums.

Rows are put in a total order by range partitions. Each partition's bytes and rows are summed; the sums
of the partitions before it, one number each, turn running sums within a partition into sums over
the whole corpus, and equal cuts of the whole give the shards. No task sees more than its own partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settle, table, unused


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text and one for its end; null has none but the end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def assign(rows: DataFrame, size: str, order: Sequence[Column], shards: int) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (from 0 within its shard, without gaps), contiguous in ``order``.

    A row belongs to the shard in which its middle byte falls, so a shard's bytes differ from the
    equal part by at most one row's at its two ends (half of each). Rows that are equal in ``order`` are told
    apart by a number written with them, so a value that very many rows share is split too. Sizes
    must be positive; products are exact up to 2^62 / shards bytes in all. A table without rows gives none.
    """
    names = unused(rows.columns, "tie", "part", "upto", "place", "before", "ahead", "start", "whole")
    tie, part, upto, place, before, ahead, start, whole = names
    numbered = settle(rows.withColumn(tie, F.monotonically_increasing_id()), "shard-rows")
    order = [*order, F.col(tie)]
    dealt = settle(numbered.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "shard-parts")
    discard(numbered)
    # one row for each partition
    sums = dealt.groupBy(part).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = settle(sums.select(
        part, F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias(before), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias(ahead), F.sum("bytes").over(all_of).alias(whole),
    ), "shard-sums")
    # a window of each partition, on a task of its own
    running = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.repartitionByRange(F.col(part)).withColumn(upto, F.sum(size).over(running)).withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(*order)).cast("long"))
    known = inside.join(F.broadcast(sums), part)
    middle = 2 * (F.col(before) + F.col(upto)) - F.col(size)
    shard = F.call_function("div", middle * shards, 2 * F.col(whole)).cast("int")
    known = settle(known.select(*rows.columns, shard.alias("shard"), (F.col(ahead) + F.col(place) - 1).alias(place)), "shard-places")
    discard(dealt, sums)
    starts = known.groupBy("shard").agg(F.min(place).alias(start))  # one row for each shard
    return known.join(F.broadcast(starts), "shard").select(*rows.columns, "shard", (F.col(place) - F.col(start)).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """All rows and columns of ``docs`` with shard and slot, by doc_id (nulls first), then size and checksum of the text.

    A column named shard or slot is replaced. Repeated ids and rows are rows of their own. A text longer than a
    shard's part stays whole, and shards that it covers stay empty. An empty table gives none.
    """
    docs = docs.drop("shard", "slot")
    (size,) = unused(docs.columns, "size")
    rows = docs.withColumn(size, byte_size(F.col("text")))
    return assign(rows, size, [F.col("doc_id").asc_nulls_first(), F.col(size), _checksum(F.col("text"))], shards).drop(size)


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write the shards of ``docs`` as Parquet folders ``shard=0`` and so on, rows by slot within each file."""
    out = shard_documents(docs, shards)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", byte_size(F.col("text")).alias("size"), _checksum(F.col("text")).alias("text_crc32"))
    placed = assign(rows, "size", [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")], 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op13_byte_shards": _query}
#: CRC-32 by a table of 256 remainders, made by the polynomial, over the bytes one by one.
ORACLES = {
    "op13_byte_shards": r"""
WITH remainders AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256))::BIGINT AS i))
), b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), d AS (
  SELECT doc_id, CAST(length(h) // 2 + 1 AS BIGINT) AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS text_crc32
  FROM b, remainders
), r AS (
  SELECT *, sum(size) OVER o AS upto, sum(size) OVER () AS whole, row_number() OVER o AS place
  FROM d WINDOW o AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), s AS (
  SELECT *, CAST(((2 * upto - size) * 16) // (2 * whole) AS INT) AS shard FROM r
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM s"""
}
