"""Daily posting plans: which clips an account posts on which day, and at what time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import captions
from ..operators import catalog
from ..sources import sinks
from ..sources.readers import local_date
from ..sources.store import KeyedTable

#: Jobs in these states take no place in the day's count. Their slots stay taken.
CLOSED = ("cancelled", "failed")
#: The zone whose days and hours are planned (fixed value).
ZONE = "America/New_York"
#: Columns of a job, in order.
JOB = ("job_id", "status", "platform", "account", "clip_id", "path", "source", "preset", "caption_text", "hashtags", "scheduled_for", "created_at", "updated_at", "notes", "external_post_id")


def of_day(jobs: DataFrame, account: str, day: str, zone: str) -> DataFrame:
    """The account's jobs on a local day, of any state; a job without a time, or with none that can be read, is on no day."""
    return jobs.filter((F.col("account") == account) & (local_date(F.col("scheduled_for"), zone) == F.lit(day).cast("date")))


def _blank(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def as_jobs(picked: DataFrame, account: str, platform: str, at: str) -> DataFrame:
    """Queued jobs (see JOB) of clips with a ``slot``; captions and hashtags are made where a clip brings none.

    An id is made of account, clip and slot, so that a plan made twice gives the same jobs.
    """
    tags = F.coalesce("tags", F.array().cast("array<string>")) if "tags" in picked.columns else F.array().cast("array<string>")
    own = F.filter(F.col("hashtags"), lambda x: F.trim(x) != "") if "hashtags" in picked.columns else F.array().cast("array<string>")
    return picked.select(
        F.md5(F.concat_ws("|", F.lit(account), F.col("clip_id").cast("string"), "slot").cast("binary")).alias("job_id"), F.lit("queued").alias("status"), F.lit(platform).alias("platform"),
        F.lit(account).alias("account"), "clip_id", _blank(picked, "path").alias("path"), F.coalesce("source", F.lit("")).alias("source"), _blank(picked, "preset").alias("preset"),
        F.coalesce(captions.first_text(_blank(picked, "caption_text")), captions.caption(tags, F.col("source"))).alias("caption_text"),
        F.when(F.size(own) > 0, F.array_distinct(F.transform(own, lambda x: F.trim(x)))).otherwise(captions.hashtags(tags)).alias("hashtags"),
        F.col("slot").alias("scheduled_for"), F.lit(at).alias("created_at"), F.lit(at).alias("updated_at"), F.lit("").alias("notes"), F.lit("").alias("external_post_id"),
    )


def daily_plan(
    clips: DataFrame, jobs: DataFrame, account: str, day: str, per_day: int = 10, start_hour: int = 8, end_hour: int = 22, tag: str = "", zone: str = ZONE, platform: str = "tiktok", seed: str = "", at: str = "",
) -> DataFrame:
    """New jobs (see JOB): as many clips as the day still needs, diverse in source, in the first free slots.

    clips: clip_id, source, what catalog.eligible() reads, and path, preset, caption_text, hashtags if there are any. jobs:
    clip_id, account, status, scheduled_for. A clip with an open job on that day is out; every job of the
    day keeps its slot, closed ones too.
    """
    account = account.strip()
    if not account:
        raise ValueError("an account is needed")
    catalog.check_hours(per_day, start_hour, end_hour)
    mine = of_day(jobs, account, day, zone)
    open_ = mine.filter(~F.coalesce("status", F.lit("")).isin(*CLOSED))
    need = max(0, per_day - open_.count())
    fit = clips.filter(catalog.eligible(F.lit(account), F.lit(tag))).join(open_.select("clip_id").distinct(), "clip_id", "left_anti")
    picked = catalog.diverse_pick(fit, "clip_id", "source", f"{seed}|{day}", need)
    free = _slots(clips, [day], per_day, start_hour, end_hour, zone).join(mine.select(F.col("scheduled_for").alias("slot")).distinct(), "slot", "left_anti")
    one = F.lit(1).alias("_one")
    both = catalog.by_position(picked.select("*", one), free.select("slot", one), ["_one"], [F.col("place")], [F.col("slot")])
    return as_jobs(both, account, platform, at)


def _slots(df: DataFrame, days: Sequence[str], per_day: int, start_hour: int, end_hour: int, zone: str) -> DataFrame:
    listed = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(d) for d in days])).alias("day"))
    return listed.select("day", F.explode(catalog.slots(F.col("day").cast("date"), F.lit(per_day), start_hour, end_hour, zone)).alias("slot"))


def several_days(
    clips: DataFrame, jobs: DataFrame, account: str, days: Sequence[str], per_day: int = 10, start_hour: int = 8, end_hour: int = 22, tag: str = "", zone: str = ZONE, platform: str = "tiktok", seed: str = "", at: str = "",
) -> DataFrame:
    """New jobs (see JOB) for all ``days`` in one plan, in which no clip comes twice.

    Days share one ranking of clips: the first clips of all sources, then their second ones, and so on, each
    time in a fixed shuffle. A day gets the next clips, as many as it needs and has free slots for. A clip
    with an open job on any of the days is out.
    """
    if not days:
        raise ValueError("no days")
    catalog.check_hours(per_day, start_hour, end_hour)
    day = local_date(F.col("scheduled_for"), zone).cast("string")
    mine = jobs.filter(F.col("account") == account).withColumn("day", day).filter(F.col("day").isin(*days))
    open_ = mine.filter(~F.coalesce("status", F.lit("")).isin(*CLOSED))
    needs = _slots(clips, days, per_day, start_hour, end_hour, zone).select("day").distinct().join(open_.groupBy("day").agg(F.count("*").alias("held")), "day", "left")
    needs = needs.select("day", F.greatest(F.lit(0), per_day - F.coalesce("held", F.lit(0))).alias("need"))
    free = _slots(clips, days, per_day, start_hour, end_hour, zone).join(mine.select(F.col("scheduled_for").alias("slot")).distinct(), "slot", "left_anti")
    free = free.join(needs, "day").withColumn("n", F.row_number().over(Window.partitionBy("day").orderBy("slot"))).filter(F.col("n") <= F.col("need"))
    # a row for each post of the days asked for
    free = free.withColumn("turn", F.row_number().over(Window.orderBy("day", "slot")))
    fit = clips.filter(catalog.eligible(F.lit(account), F.lit(tag))).join(open_.select("clip_id").distinct(), "clip_id", "left_anti")
    rnd = catalog.shuffled(F.lit(f"{seed}|{days[0]}"), F.col("clip_id").cast("string"))
    fit = fit.withColumn("_rnd", rnd).withColumn("_k", F.row_number().over(Window.partitionBy("source").orderBy("_rnd", "clip_id")))
    fit = fit.withColumn("_k", F.when(F.coalesce("source", F.lit("")) == "", F.lit(2**31 - 1)).otherwise(F.col("_k")))
    top = fit.orderBy("_k", "_rnd", "clip_id").limit(per_day * len(days))
    ranked = top.withColumn("turn", F.row_number().over(Window.orderBy("_k", "_rnd", "clip_id")))
    return as_jobs(ranked.drop("_k", "_rnd").join(free.select("turn", "slot"), "turn"), account, platform, at)


def plan_row(plan: DataFrame, jobs: DataFrame, account: str, day: str, per_day: int = 10, start_hour: int = 8, end_hour: int = 22, tag: str = "", zone: str = ZONE, platform: str = "tiktok", dry_run: bool = False, at: str = "") -> DataFrame:
    """The one row that is kept of a day's plan, under account__date: what was asked, what was there, the jobs made."""
    before = of_day(jobs, account, day, zone).filter(~F.coalesce("status", F.lit("")).isin(*CLOSED)).agg(F.count("*").alias("existing"))
    made = plan.agg(F.count("*").alias("created"), F.sort_array(F.collect_list(F.struct("scheduled_for", "job_id", "clip_id"))).alias("jobs"))
    both = before.crossJoin(made)  # one row by one row
    return both.select(
        F.lit(f"{account}__{day}").alias("plan_key"), F.lit(account).alias("account"), F.lit(day).alias("date"), F.lit(per_day).cast("long").alias("target"), "existing", "created",
        F.greatest(F.lit(0), per_day - F.col("existing") - F.col("created")).alias("unfilled"), F.lit(start_hour).alias("start_hour"), F.lit(end_hour).alias("end_hour"), F.lit(tag).alias("tag"),
        F.lit(platform).alias("platform"), F.lit(dry_run).alias("dry_run"), "jobs", F.lit(at).alias("updated_at"),
    )


def history_rows(plan: DataFrame, row: DataFrame, at: str, dry_run: bool = False) -> DataFrame:
    """What the log gets: a row for each job made, unless it was a dry run, and one for the run."""
    run = row.select(F.lit("daily_schedule_run").alias("type"), "account", F.lit(None).cast("string").alias("job_id"), F.col("date").alias("about"), "created", "dry_run", F.lit(at).alias("at"))
    each = plan.select(F.lit("scheduled_job_created").alias("type"), "account", "job_id", F.col("scheduled_for").alias("about"), F.lit(1).cast("long").alias("created"), F.lit(False).alias("dry_run"), F.lit(at).alias("at"))
    return run if dry_run else each.unionByName(run)


def record_day(plan: DataFrame, jobs: DataFrame, plans: DataFrame | None, account: str, day: str, at: str, dry_run: bool = False, **asked) -> tuple[DataFrame, DataFrame, DataFrame]:
    """jobs, plans and history rows after ``plan``: jobs are appended, the day's plan replaces an older one. A dry run writes the plan but no job."""
    row = plan_row(plan, jobs, account, day, dry_run=dry_run, at=at, **asked)
    out = jobs if dry_run else jobs.unionByName(plan.select(*[c for c in jobs.columns if c in plan.columns]), allowMissingColumns=True)
    return out, row if plans is None else sinks.upsert(plans.select(*row.columns), row, ["plan_key"]), history_rows(plan, row, at, dry_run)


def write_day(clips: DataFrame, queue: KeyedTable, plans: KeyedTable, history: str, account: str, day: str, at: str, dry_run: bool = False, zone: str = ZONE, seed: str = "", **asked) -> int:
    """Plan a day and write queue (by job_id), plan (by plan_key) and log; returns how many jobs were made.

    The queue goes first. A run that dies after it is made up for by the next, which finds the jobs there.
    """
    jobs = queue.read()
    plan = daily_plan(clips, jobs, account, day, zone=zone, seed=seed, at=at, **asked).cache()
    try:
        row = plan_row(plan, jobs, account, day, zone=zone, dry_run=dry_run, at=at, **asked).cache()
        made = row.first()["created"]
        if made and not dry_run:
            queue.upsert(plan.select(*JOB))
        plans.upsert(row)
        sinks.append_history(history_rows(plan, row, at, dry_run), history)
        row.unpersist()
    finally:
        plan.unpersist()
    return made
