"""Transcription chunks as a stream: overlapping chunks come in, each segment is kept once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals
from ..sources.store import KeyedTable


def owned_segments(read: DataFrame, overlap: str) -> DataFrame:
    """The segments that belong to their chunk, those alike within ``overlap`` once.

    read: a stream of segments with their chunk's keep_start, keep_end and last_chunk, and ``at``, when the
    chunk came in. A segment belongs to the chunk in which its middle lies; what comes later than the overlap is dropped.
    The state holds a segment's times and a hash of its text, not the text.
    """
    told = intervals.owned_by_midpoint(read).withColumn("said", F.xxhash64("text")).withWatermark("at", overlap)
    return told.dropDuplicatesWithinWatermark(["doc_id", "start_c", "end_c", "said"]).drop("said")


def collect_segments(read: DataFrame, table: KeyedTable, checkpoint: str, overlap: str, name: str = "chunks") -> None:
    """Put the owned segments of a stream into ``table`` (by doc_id and idx), to the stream's present end."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("doc_id", "idx", "text", "start_c", "end_c")
        if not table.exists():  # nothing to compare with: the batch is worked out once
            table.upsert(rows, once=(name, batch_id), unique=True)
            return
        rows = rows.persist()
        try:
            table.upsert(rows, once=(name, batch_id), unique=True)
        finally:
            rows.unpersist()

    owned_segments(read, overlap).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged(segments: DataFrame) -> DataFrame:
    """doc_id, text, n: each document's text in the order of its segments."""
    listed = F.sort_array(F.collect_list(F.struct("idx", "text")))
    return segments.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias("text"), F.count("*").alias("n"))
