"""Posting as streams: due jobs are sent a few at a time, status changes are followed job by job.

Both write keyed tables with the number of the batch, so that a batch that a restart brings again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import catalog
from ..sources import sinks
from ..sources.store import KeyedTable

#: What a run says of each job it took: claimed, then sent or failed.
LEDGER = "batch_id long, job_id string, state string, external_post_id string, note string, at string"
INTERRUPTED = "interrupted before its outcome was written; not sent again"


def sending(upload: Callable[[dict], str]) -> Callable[[DataFrame], DataFrame]:
    """A sender that calls ``upload`` for each job on the executors; what it returns is the post's id, what it raises the error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                try:
                    out.append((row["job_id"], str(upload(row)), None))
                except Exception as exc:  # one job's failure is its own
                    out.append((row["job_id"], None, str(exc)))
            yield pd.DataFrame(out, columns=["job_id", "external_post_id", "error"])

    return lambda jobs: jobs.mapInPandas(run, "job_id string, external_post_id string, error string")


def due_jobs(queue: DataFrame, now: Column, limit: int, account: str = "", platform: str = "tiktok") -> DataFrame:
    """The first ``limit`` queued jobs that are due, those without a time first."""
    due = queue.filter((F.coalesce("platform", F.lit("tiktok")) == platform) & (F.col("status") == "queued") & catalog.due(F.col("scheduled_for"), now))
    due = due.filter(F.col("account") == account.strip()) if account.strip() else due
    return due.orderBy(F.coalesce("scheduled_for", F.lit("")), "job_id").limit(limit)


def send_due(queue: KeyedTable, ledger: KeyedTable, accounts: DataFrame, send: Callable[[DataFrame], DataFrame], batch_id: int, now: Column, limit: int = 3, account: str = "", platform: str = "tiktok", at: str = "") -> None:
    """One run: claim due jobs, send them, keep what came of each, mark the jobs.

    Jobs are claimed in the ledger before anything is sent. If the run dies then, the same run again sends
    nothing: a claim without an outcome fails, as it may have been sent. A job is marked only while it is queued.
    """
    spark = queue.spark
    held = ledger.read().filter(F.col("batch_id") == batch_id) if ledger.exists() else spark.createDataFrame([], LEDGER)
    line = lambda df, state, post, note: df.select(F.lit(batch_id).cast("long").alias("batch_id"), "job_id", state.alias("state"), post.alias("external_post_id"), note.alias("note"), F.lit(at).alias("at"))
    none = F.lit(None).cast("string")
    if held.isEmpty():
        ledger.upsert(line(due_jobs(queue.read(), now, limit, account, platform), F.lit("claimed"), none, none))
        claimed = ledger.read().filter(F.col("batch_id") == batch_id).select("job_id")
        jobs = catalog.with_account(queue.read().join(F.broadcast(claimed), "job_id"), accounts)  # no more than ``limit``
        jobs = jobs.withColumn("error", F.coalesce(F.when(F.trim(F.coalesce("path", F.lit(""))) == "", F.concat(F.lit("missing file: "), F.coalesce("path", F.lit("")))), "error"))
        sent = send(jobs.filter("error IS NULL").drop("error")).select("job_id", "external_post_id", "error")
        sent = sent.unionByName(jobs.filter("error IS NOT NULL").select("job_id", none.alias("external_post_id"), "error"))
        ledger.upsert(line(sent, F.when(F.col("error").isNull(), "sent").otherwise("failed"), F.col("external_post_id"), F.col("error")))
    else:
        open_ = held.filter("state = 'claimed'")
        if not open_.isEmpty():
            ledger.upsert(line(open_, F.lit("failed"), none, F.lit(INTERRUPTED)))
    told = ledger.read().filter((F.col("batch_id") == batch_id) & (F.col("state") != "claimed")).select(F.col("job_id").alias("_j"), F.col("state").alias("_state"), F.col("external_post_id").alias("_post"), F.col("note").alias("_note"))

    def mark(old: DataFrame) -> DataFrame:
        both = old.join(F.broadcast(told), F.col("job_id") == F.col("_j"), "left")  # no more than ``limit``
        hit = F.col("_j").isNotNull() & (F.col("status") == "queued")
        new = {
            "status": F.when(F.col("_state") == "sent", "draft_ready").otherwise("failed"), "external_post_id": F.coalesce("_post", "external_post_id"),
            "notes": F.coalesce("_note", F.lit("uploaded as a draft")), "updated_at": F.lit(at),
        }
        return both.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in old.columns])

    queue.merge(told.select(F.col("_j").alias("job_id")), mark)


def poll(arrivals: DataFrame, queue: KeyedTable, ledger: KeyedTable, accounts: DataFrame, send: Callable[[DataFrame], DataFrame], checkpoint: str, now: Column, name: str = "poll", **how) -> None:
    """Take new jobs from a stream into the queue, known ones stay as they are, and make one run for each micro-batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        queue.refresh(batch, [], once=(name, batch_id))
        send_due(queue, ledger, accounts, send, batch_id, now, **how)

    arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def transitions(changes: DataFrame, jobs: DataFrame | None) -> DataFrame:
    """event_id, job_id, clip_id, account, before, status, at: each change with the status that the job had.

    ``jobs``: job_id and the status that stands so far. Any status may follow any other; changes are put in order of time.
    """
    by_time = Window.partitionBy("job_id").orderBy("at", "event_id")
    rows = changes.withColumn("_lag", F.lag("status").over(by_time))
    if jobs is not None:
        rows = rows.join(jobs.select("job_id", F.col("status").alias("_was")), "job_id", "left").withColumn("_lag", F.coalesce("_lag", "_was"))
    return rows.select("event_id", "job_id", "clip_id", "account", F.col("_lag").alias("before"), "status", "at")


def apply_changes(changes: DataFrame, jobs: KeyedTable, pool: KeyedTable, history: str, checkpoint: str, late: str = "2 hours", name: str = "changes") -> None:
    """Bring jobs (by job_id) and pool (by clip_id) up to date with a stream of changes, to its present end.

    changes: event_id, job_id, clip_id, account, status, at. A change that comes again within the watermark
    counts once, in the state of the stream; so does a batch that a restart brings again, by its number in the tables.
    jobs keep their latest status by time; each change to ``posted`` adds to its clip. The log may hold a batch
    twice if a run died behind it; its rows carry event ids.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            known = jobs.read(jobs.touched(batch)) if jobs.exists() else None
            if jobs.done(name) < batch_id:
                moved = transitions(batch, known)
                sinks.append_history(moved.withColumn("batch_id", F.lit(batch_id).cast("long")), history)
            newest = batch.groupBy("job_id").agg(F.max_by(F.struct("clip_id", "account", "status", "at"), F.struct("at", "event_id")).alias("r")).select("job_id", "r.*")
            if known is not None:
                newest = newest.join(known.select("job_id", F.col("at").alias("_at")), "job_id", "left").filter(F.col("_at").isNull() | (F.col("at") >= F.col("_at"))).drop("_at")
            posted = batch.filter("status = 'posted'").withColumn("posted_at", F.col("at"))
            pool.merge(posted, lambda old: catalog.posted_updates(old, posted), once=(name, batch_id))
            jobs.upsert(newest, once=(name, batch_id))
        finally:
            batch.unpersist()

    once = changes.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    once.writeStream.outputMode("append").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
