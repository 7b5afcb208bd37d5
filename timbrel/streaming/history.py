"""Structured Streaming over append-only tables: history counts, polling of due jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, per_trigger: int = 64, glob: str | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return (r.option("pathGlobFilter", glob) if glob else r).parquet(path)


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """hour, event_type, n over event time; rows later than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("hour"), "event_type", "n")


def without_repeats(rows: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_end(df: DataFrame, sink_path: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what is there now, exactly once per checkpoint, and stop."""
    q = df.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def poll(df: DataFrame, handle, checkpoint: str) -> None:
    """Give each micro-batch to ``handle(batch, batch_id)``, which should be idempotent by batch_id."""
    df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
