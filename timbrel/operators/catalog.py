"""The relational side of a publishing catalogue: who may post what, when, and what is queued."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _has(arr: str, value: Column) -> Column:
    return F.coalesce(F.array_contains(F.coalesce(F.col(arr), F.array().cast("array<string>")), value), F.lit(False))


def eligible(account: Column, tag: Column) -> Column:
    """Approved, tagged (unless the tag is blank), not blocked, allowed (an empty list allows all), not posted yet."""
    free = F.coalesce(F.size("allowed_accounts"), F.lit(0)) <= 0
    return (F.col("status") == "approved") & ((tag == "") | _has("tags", tag)) & ~_has("blocked_accounts", account) & (free | _has("allowed_accounts", account)) & ~_has("posted_accounts", account)


def due(scheduled: Column, now: Column) -> Column:
    """Nothing scheduled is due; what isn't a time is not; else when its time has come."""
    at = F.try_to_timestamp(scheduled)
    return scheduled.isNull() | F.coalesce(at <= now, F.lit(False))


def status_counts(df: DataFrame, by: Sequence[str], statuses: Sequence[str]) -> DataFrame:
    """Total and one count for each known status; an unknown one counts in the total only."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def first_of_providers(rows: DataFrame, by: Sequence[str], priority: Column) -> DataFrame:
    """Rows of the first provider that has any."""
    w = Window.partitionBy(*by)
    return rows.withColumn("_p", priority).withColumn("_m", F.min("_p").over(w)).filter("_p = _m").drop("_p", "_m")


def provider_errors(answers: DataFrame, by: Sequence[str], priority: Column) -> DataFrame:
    """by, errors: what went wrong at the providers that were asked, in their order: those up to the first with rows.

    answers: by, provider, found (number of rows) and error (null if none), a row for each provider.
    """
    w = Window.partitionBy(*by)
    asked = answers.withColumn("_p", priority).withColumn("_m", F.min(F.when(F.coalesce("found", F.lit(0)) > 0, F.col("_p"))).over(w))
    asked = asked.filter(F.col("_m").isNull() | (F.col("_p") <= F.col("_m")))
    said = F.when(F.col("error").isNotNull(), F.struct("_p", F.concat_ws(": ", "provider", "error").alias("e")))
    return asked.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(said)), lambda x: x["e"]).alias("errors"))


def best_rendition(rows: DataFrame, by: Sequence[str], prefer_portrait: bool = True, allow_landscape: bool = True, order: Column | None = None) -> DataFrame:
    """by, file_id, width, height: one file of each group. A square is landscape; a file without a link (``link`` blank or null, if there is one) doesn't count.

    The largest portrait file if that is preferred, else the largest landscape one if allowed, else the largest
    portrait one, else the first file. ``order`` ranks files within a kind otherwise, the highest first (tiers for
    instance). Ties: the smaller file id.
    """
    if "link" in rows.columns:
        rows = rows.filter(F.trim(F.coalesce("link", F.lit(""))) != "")
    tall = F.coalesce(F.col("height") > F.col("width"), F.lit(False))
    rank = F.when(tall & F.lit(prefer_portrait), 3).when(~tall & F.lit(allow_landscape), 2).when(tall, 1).otherwise(0)
    area = F.coalesce(F.col("width") * F.col("height"), F.lit(0)) if order is None else order
    # where landscape isn't allowed it is the last resort, by order of files
    within = F.when(rank > 0, area).otherwise(F.lit(0)) if order is None else area
    key = F.struct(rank.alias("r"), within.alias("a"), (-F.col("file_id")).alias("i"))
    return rows.groupBy(*by).agg(F.max_by(F.struct("file_id", "width", "height"), key).alias("r")).select(*by, "r.*")


def without_terms(text: Column, reject: Sequence[str]) -> Column:
    """No token of the text is on the list."""
    tokens = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s,;|/()\[\]]+")
    return ~F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in reject]))


def shuffled(*parts: Column) -> Column:
    """A fixed shuffle: md5 of a seed and the id."""
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def diverse_pick(clips: DataFrame, key: str, source: str, seed: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """``n`` rows, one of each source before a second of any; within that in a fixed shuffle. + place (from 1)."""
    rnd = shuffled(F.lit(seed), F.col(key).cast("string"))
    df = clips.withColumn("_rnd", rnd)
    df = df.withColumn("_k", F.row_number().over(Window.partitionBy(*by, source).orderBy("_rnd", key)))
    df = df.withColumn("_again", F.when((F.coalesce(F.col(source), F.lit("")) != "") & (F.col("_k") == 1), 0).otherwise(1))
    if by:
        return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_again", "_rnd", key)).cast("long")).filter(F.col("place") <= n).drop("_rnd", "_k", "_again")
    # no group: the n first are found by a distributed top-n before they are numbered
    top = df.orderBy("_again", "_rnd", key).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy("_again", "_rnd", key)).cast("long")).drop("_rnd", "_k", "_again")


def check_hours(per_day: int, start_hour: int, end_hour: int) -> None:
    if per_day < 1:
        raise ValueError("a day needs one post at least")
    if not (0 <= start_hour <= 23 and 1 <= end_hour <= 24 and start_hour < end_hour):
        raise ValueError("hours must be 0 to 23 and 1 to 24, the first before the second")


def slots(day: Column, n: Column, start_hour: int = 8, end_hour: int = 22, zone: str | None = None) -> Column:
    """``n`` wall-clock times in the middle of equal parts of [start_hour, end_hour), as ISO text; n <= 0: none.

    Parts are exact to the microsecond, which are shown where there are any. With ``zone`` each
    time carries that zone's offset then.
    """
    check_hours(1, start_hour, end_hour)
    span = (end_hour - start_hour) * 3600 * 1_000_000
    k = F.greatest(n, F.lit(1)).cast("long")
    index = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: start_hour * 3600 * 1_000_000 + F.call_function("div", (2 * i + 1) * span + k, 2 * k))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")

    def text(us: Column) -> Column:
        s = F.call_function("div", us, F.lit(1_000_000).cast("long"))
        part = lambda size, within=None: F.call_function("div", s, F.lit(size).cast("long")) % (within or 10**9)
        whole = F.concat(day.cast("string"), F.lit("T"), two(part(3600)), F.lit(":"), two(part(60, 60)), F.lit(":"), two(s % 60))
        us = us % 1_000_000
        shown = F.when(us == 0, whole).otherwise(F.concat(whole, F.lit("."), F.lpad(us.cast("string"), 6, "0")))
        return shown if zone is None else F.concat(shown, _offset(F.to_timestamp(whole), zone))

    return F.when(n > 0, F.transform(index, text)).otherwise(F.array().cast("array<string>"))


def _offset(wall: Column, zone: str) -> Column:
    """+hh:mm or -hh:mm of a zone at a wall-clock time."""
    minutes = F.call_function("div", F.unix_timestamp(wall) - F.unix_timestamp(F.to_utc_timestamp(wall, zone)), F.lit(60).cast("long"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    size = F.abs(minutes)
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), two(F.call_function("div", size, F.lit(60).cast("long"))), F.lit(":"), two(size % 60))


def by_position(left: DataFrame, right: DataFrame, by: Sequence[str], left_order: Sequence[Column], right_order: Sequence[Column]) -> DataFrame:
    """The first of the one with the first of the other, and so on, within ``by``."""
    a = left.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*left_order)))
    b = right.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*right_order)))
    return a.join(b, [*by, "_n"]).drop("_n")


def without_active_job(clips: DataFrame, jobs: DataFrame, on: Sequence[str], closed: Sequence[str]) -> DataFrame:
    """Clips without a job whose status isn't one of the closed ones."""
    return clips.join(jobs.filter(~F.col("status").isin(*closed)).select(*on).distinct(), list(on), "left_anti")


def last_status(history: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key wins; any status may follow any other."""
    rest = [c for c in history.columns if c != key]
    return history.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("r")).select(key, "r.*")


def posted_updates(pool: DataFrame, jobs: DataFrame, key: str = "clip_id") -> DataFrame:
    """``pool`` after the jobs that became ``posted``: counts, accounts and the last time are brought up to date.

    pool: key, post_count, posted_accounts, last_posted_at and more. jobs: key, account, status,
    posted_at. Each posted job counts; an account is listed once, in the order of first posting.
    """
    done = jobs.filter("status = 'posted'").groupBy(F.col(key).alias("_k")).agg(
        F.count("*").alias("_n"), F.max("posted_at").alias("_at"), F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("posted_at", "account"))), lambda x: x["account"])).alias("_who")
    )
    both = pool.join(done, F.col(key) == F.col("_k"), "left")
    none = F.array().cast("array<string>")
    new = {
        "post_count": (F.coalesce("post_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long"),
        "posted_accounts": F.array_distinct(F.concat(F.coalesce("posted_accounts", none), F.coalesce("_who", none))),
        "last_posted_at": F.coalesce("_at", "last_posted_at"),
    }
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in pool.columns])


def posted_history(jobs: DataFrame, key: str = "clip_id") -> DataFrame:
    """Rows for the history log: one for each posted job."""
    return jobs.filter("status = 'posted'").select(F.lit("posted").alias("type"), key, "account", F.col("posted_at").alias("at"))


def with_account(jobs: DataFrame, accounts: DataFrame) -> DataFrame:
    """Jobs with their account's token, and an error where the account or its token is missing."""
    a = accounts.select(F.col("account").alias("_a"), F.trim("access_token").alias("_t"))
    j = jobs.join(a, F.col("account") == F.col("_a"), "left")
    error = F.when(F.col("_a").isNull(), F.concat(F.lit("account not found: "), F.col("account"))).when(F.coalesce("_t", F.lit("")) == "", F.concat(F.lit("missing access_token for account: "), F.col("account")))
    return j.select(*jobs.columns, F.when(error.isNull(), F.col("_t")).alias("access_token"), error.alias("error"))


def upcoming(status: Column, at: Column, now: Column) -> Column:
    """Waiting, and its time hasn't passed."""
    return status.isin("queued", "draft_ready") & F.coalesce(at >= now, F.lit(False))


def changed_rows(old: Column, new: Column) -> Column:
    """How many rows a rewriting changed: an empty new text keeps the trimmed old one."""
    before = F.trim(F.coalesce(old, F.lit("")))
    after = F.trim(F.coalesce(F.when(new != "", new), before))
    return F.count_if(after != before)


def worst(items: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, value: the largest of each group; an unknown value counts as mid-grey."""
    return items.groupBy(*by).agg(F.max(F.coalesce(value, F.lit(128))).alias(value))


def day_bounds(day: Column) -> tuple[Column, Column]:
    """First moment of a local day and of the next; text that isn't a date gives null."""
    d = F.try_to_date(day, "yyyy-MM-dd") if hasattr(F, "try_to_date") else day.try_cast("date")
    return d.cast("timestamp_ntz"), F.date_add(d, 1).cast("timestamp_ntz")
