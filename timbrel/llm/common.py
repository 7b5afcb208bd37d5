"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch, where the session doesn't name other numbers than the usual.
BATCH_ROWS, BATCH_BYTES = 2000, "16m"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers that start later find this package where the driver found it."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])
    if _ROOT not in sys.path:
        sys.path.insert(0, _ROOT)
    # ten thousand long texts in one batch would fill a worker
    for name, usual, ours in (("maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", ours)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving freed memory back at a task's end: workers live on and share the machine with the next task's."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``most`` bytes in one column; each row stays whole."""
    for b in batches:
        at, held = 0, 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0).to_pylist()
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield b.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < b.num_rows:
            yield b.slice(at)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where the session names none on one machine (tests) a temporary one is made; on a
    cluster that would be a folder that other machines can't see, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="timbrel-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, executors may go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def discard(*settled: DataFrame) -> None:
    """Delete settled tables. Only for those on which nothing still to be computed depends."""
    for df in settled:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.settled_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sized(settled: DataFrame, rows: int = 100_000) -> DataFrame:
    """A settled narrow table, marked for broadcast if it has no more than ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(settled) if settled.count() <= rows else settled


def repeated_ids(docs: DataFrame) -> DataFrame:
    """(_many): values of doc_id under which different texts stand. Settled; empty as a rule."""
    ids = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_many"), F.xxhash64("text").alias("th"))
    return settle(ids.groupBy("_many").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).filter("lo < hi").select("_many"), "repeated-ids")


def with_version(docs: DataFrame, repeated: DataFrame, doc_id: str = "doc_id", name: str = "version") -> DataFrame:
    """Add a number that tells rows of one doc_id with different texts apart; 0 where there is but one text."""
    (many,) = unused([*docs.columns, name], "_many")
    both = docs.join(sized(repeated).withColumnRenamed("_many", many), F.col(doc_id).cast("long") == F.col(many), "left")
    return both.withColumn(name, F.when(F.col(many).isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop(many)


def unused(taken: Sequence[str], *wanted: str) -> list[str]:
    """Names for helper columns that are not among ``taken``, whatever these are."""
    held, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name in held:
            name += "_"
        held.add(name)
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod ``n`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def ranked(df: DataFrame, order: list[Column], what: str, partitions: int | None = None) -> DataFrame:
    """Add ``rank`` (from 0) in a total order without bringing all rows to one task.

    Range partitions are sorted one by one; each partition's first rank is the number of
    rows in the partitions before it. Only those counts, one per partition, reach the driver.
    """
    parts = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    done = settle(parts.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), what)
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r[0], r[1]) for r in done.groupBy(part.alias("p")).count().collect())
    first, starts = 0, []
    for p, n in counts:
        starts.append((p, first))
        first += n
    # one row for each partition
    starts = F.broadcast(df.sparkSession.createDataFrame(starts, "_p long, _first long"))
    return done.join(starts, part == F.col("_p")).withColumn("rank", F.col("_first") + row).drop("_at", "_p", "_first")
