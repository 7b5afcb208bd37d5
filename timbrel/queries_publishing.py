"""Queries of posting streams, chunk streams, model answers and batch manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import model_output
from .operators import folds
from .plans import clips as clip_plans
from .plans import subtitles
from .queries import CLIP, JOBS, ORACLES, SEG, WORDS, _clips, _jobs, _read_chunks, _seg, event_stream, query
from .sources import sinks
from .sources.readers import table
from .sources.store import KeyedTable, shared_folder
from .streaming import chunks, history, posting

DUE = 100


@query("WITH " + JOBS + f""", due AS (SELECT * FROM jobs WHERE status = 'queued' AND (scheduled_for IS NULL OR (scheduled_for <> 'soon' AND CAST(nullif(scheduled_for, 'soon') AS TIMESTAMP) <= TIMESTAMP '2024-01-08')) ORDER BY coalesce(scheduled_for, ''), CAST(event_id AS VARCHAR) LIMIT {DUE}),
told AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'missing file: ' WHEN user_id % 3 = 0 THEN 'account not found: ' || account WHEN user_id % 5 = 0 THEN 'missing access_token for account: ' || account END AS error FROM due)
SELECT CAST(j.event_id AS VARCHAR) AS job_id, CASE WHEN t.event_id IS NULL THEN j.status WHEN error IS NULL THEN 'draft_ready' ELSE 'failed' END AS status,
  CASE WHEN t.event_id IS NULL THEN '' WHEN error IS NULL THEN 'p' || j.event_id ELSE '' END AS external_post_id, CASE WHEN t.event_id IS NULL THEN '' ELSE coalesce(error, 'uploaded as a draft') END AS notes
FROM jobs j LEFT JOIN told t ON t.event_id = j.event_id""")
def upload_due(spark, d):
    """All jobs, taken from a stream into a table, after one run that sends the first hundred due ones; failures are kept."""
    text = lambda c: F.lit("").alias(c)
    fields = lambda j: j.select(F.col("event_id").cast("string").alias("job_id"), "status", F.lit("tiktok").alias("platform"), "account", "clip_id", F.when(F.col("event_id") % 7 > 0, "there").otherwise("").alias("path"), "scheduled_for", text("external_post_id"), text("notes"), text("updated_at"))
    u = F.col("user_id")
    accounts = _jobs(spark, d).filter(u % 3 > 0).select("account", F.when(u % 5 > 0, F.concat(F.lit("t"), u.cast("string"))).otherwise(" ").alias("access_token")).distinct()
    queue, ledger = KeyedTable(spark, shared_folder(spark, "queue"), ["job_id"], 16), KeyedTable(spark, shared_folder(spark, "ledger"), ["batch_id", "job_id"], 4)
    send = lambda jobs: jobs.select("job_id", F.concat(F.lit("p"), "job_id").alias("external_post_id"), F.lit(None).cast("string").alias("error"))
    arrivals = fields(_jobs(spark, d, event_stream(spark, d)))
    posting.poll(arrivals, queue, ledger, accounts, send, shared_folder(spark, "state"), F.lit("2024-01-08T00:00:00").cast("timestamp"), limit=DUE)
    return queue.read().select("job_id", "status", "external_post_id", "notes")


@query(ORACLES["posted_updates"])
def posted_stream(spark, d):
    """The pool after all status changes, followed job by job as a stream; equal to the batch answer."""
    i = F.col("doc_id")
    pool = KeyedTable(spark, shared_folder(spark, "pool"), ["clip_id"], 16)
    pool.write(table(spark, d, "documents").select(i.alias("clip_id"), (i % 3).alias("post_count"), F.when(i % 11 == 0, F.array(F.lit("a1"))).alias("posted_accounts"), F.lit(None).cast("timestamp").alias("last_posted_at")))
    changes = _jobs(spark, d, event_stream(spark, d)).select("event_id", F.concat_ws("|", "clip_id", "account").alias("job_id"), "clip_id", "account", "status", F.col("ts").alias("at"))
    jobs = KeyedTable(spark, shared_folder(spark, "jobs"), ["job_id"], 16)
    posting.apply_changes(changes, jobs, pool, shared_folder(spark, "history"), shared_folder(spark, "state"))
    return pool.read().select("clip_id", "post_count", F.array_join("posted_accounts", ",").alias("posted_accounts"), F.date_format("last_posted_at", "yyyy-MM-dd'T'HH:mm:ss").alias("last_posted_at"))


@query(ORACLES["chunk_merge"])
def chunk_merge_stream(spark, d):
    """Overlapping chunks of all documents as a stream: each segment once, texts as in the batch."""
    staged = shared_folder(spark, "chunks")
    # a chunk comes in when its time is over; all documents run at once
    at = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("chunk") + 1) * 60)
    _read_chunks(spark, d).select("doc_id", "chunk", "idx", "text", "start_c", "end_c", "keep_start", "keep_end", "last_chunk", at.alias("at")).write.parquet(staged)
    read = history.read_stream(spark, staged, spark.read.parquet(staged).schema, per_trigger=100_000)
    kept = KeyedTable(spark, shared_folder(spark, "segments"), ["doc_id", "idx"], 16)
    chunks.collect_segments(read, kept, shared_folder(spark, "state"), "2 minutes")
    return chunks.merged(kept.read())


# an answer for each chunk of six segments: 0 plain, 1 fenced, 2 cut off, 3 one text short and one blank, 4 an index that is none, else none at all
_ANSWER = """lst AS (SELECT doc_id, chunk, to_json(list({'index': k, 'text': CASE WHEN (doc_id + chunk) % 7 = 3 AND k = 1 THEN ' ' ELSE '* ' || text END} ORDER BY k) FILTER (NOT ((doc_id + chunk) % 7 = 3 AND k = 0))) AS j FROM num GROUP BY ALL),
ans AS (SELECT doc_id, chunk, CASE (doc_id + chunk) % 7 WHEN 1 THEN '```json' || chr(10) || '{"corrected_segments":' || coalesce(j, '[]') || '}' || chr(10) || '```' WHEN 2 THEN '{"corrected_segments":' || substr(j, 1, length(j) - 2)
  WHEN 4 THEN '{"corrected_segments":[{"index":-1,"text":"x"}]}' ELSE '{"corrected_segments":' || coalesce(j, '[]') || '}' END AS raw FROM lst WHERE (doc_id + chunk) % 7 < 5)"""


@query("WITH " + SEG + ", num AS (SELECT doc_id, idx, idx // 6 AS chunk, idx % 6 AS k, text FROM seg), " + _ANSWER + """, bare AS (SELECT doc_id, chunk, CASE WHEN starts_with(raw, '```') THEN trim(substr(trim(raw, '`'), 5), ' ' || chr(10)) ELSE raw END AS r FROM ans),
ok AS (SELECT doc_id, chunk, json_valid(r) AS valid, CASE WHEN json_valid(r) THEN r END AS r FROM bare), it AS (SELECT doc_id, chunk, valid, unnest(CASE WHEN valid THEN CAST(json_extract(r, '$.corrected_segments') AS JSON[]) ELSE [NULL] END) AS x FROM ok),
ck AS (SELECT o.doc_id, o.chunk, any_value(o.valid) AS valid, count(*) FILTER (CAST(x->>'index' AS BIGINT) < 0) AS bad FROM ok o LEFT JOIN it ON it.doc_id = o.doc_id AND it.chunk = o.chunk GROUP BY ALL)
SELECT n.doc_id, n.idx, coalesce(c.valid AND c.bad = 0, false) AS used, CASE WHEN coalesce(c.valid AND c.bad = 0, false) THEN coalesce(nullif(trim(i.x->>'text', ' '), ''), n.text) ELSE n.text END AS text,
  CASE WHEN c.doc_id IS NULL THEN 'no answer' WHEN NOT c.valid THEN 'not JSON' WHEN c.bad > 0 THEN 'corrected_segments: faulty entry' END AS error
FROM num n LEFT JOIN ck c ON c.doc_id = n.doc_id AND c.chunk = n.chunk LEFT JOIN it i ON i.doc_id = n.doc_id AND i.chunk = n.chunk AND CAST(i.x->>'index' AS BIGINT) = n.k""")
def refined_segments(spark, d):
    """Segments after a model's answers, one for each chunk: good, fenced, cut off, incomplete, faulty and missing ones."""
    num = model_output.numbered(folds.fixed_chunks(_seg(spark, d), 6).select("doc_id", "idx", "chunk", "text"), ["doc_id", "chunk"])
    i = (F.col("doc_id") + F.col("chunk")) % 7
    k = F.col("local_index")
    entry = F.struct(k.alias("index"), F.when((i == 3) & (k == 1), " ").otherwise(F.concat(F.lit("* "), "text")).alias("text"))
    listed = num.groupBy("doc_id", "chunk").agg(F.to_json(F.sort_array(F.collect_list(F.when(~((i == 3) & (k == 0)), entry)))).alias("j"))
    whole = F.concat(F.lit('{"corrected_segments":'), "j", F.lit("}"))
    raw = F.when(i == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(i == 2, F.concat(F.lit('{"corrected_segments":'), F.substr("j", F.lit(1), F.length("j") - 2)))
    raw = raw.when(i == 4, F.lit('{"corrected_segments":[{"index":-1,"text":"x"}]}')).otherwise(whole)
    answers = listed.filter(i < 5).select("doc_id", "chunk", raw.alias("raw"))
    return model_output.refined(num, answers, ["doc_id", "chunk"]).select("doc_id", "idx", "used", "text", "error")


# plans by document: 0 whole, 1 without stem and language, 2 clips that are no list, 3 numbers written as strings, 4 one out of range, 5 cut off, 6 a list instead of an object, 7 a title missing
_PLAN = CLIP + """, cj AS (SELECT doc_id, to_json(list(json_object('title', 't' || place, 'hook', 'h', 'start_sec', start_c // 15, 'end_sec', end_c // 15, 'duration_sec', (end_c - start_c) // 15, 'confidence', 1, 'why_it_works', '', 'add_broll', true, 'broll_query', '') ORDER BY place)) AS j, count(*) AS n, sum(end_c // 15 - start_c // 15) AS secs FROM clip GROUP BY doc_id)"""


@query("WITH " + _PLAN + """ SELECT doc_id, CASE WHEN doc_id % 8 IN (4, 5, 7) THEN NULL WHEN doc_id % 8 IN (1, 6) THEN 's' || doc_id ELSE 'made' END AS source_stem, CASE WHEN doc_id % 8 IN (4, 5, 7) THEN NULL WHEN doc_id % 8 IN (1, 6) THEN 'Arabic' ELSE 'xx' END AS language,
  CASE WHEN doc_id % 8 IN (4, 5, 7) THEN NULL WHEN doc_id % 8 IN (2, 6) THEN 0 ELSE n END AS n, CAST(CASE WHEN doc_id % 8 IN (2, 4, 5, 6, 7) THEN NULL ELSE secs END AS DOUBLE) AS secs, CASE WHEN doc_id % 8 IN (2, 4, 5, 6, 7) THEN NULL ELSE 'alternate_scenic' END AS mode,
  CASE doc_id % 8 WHEN 4 THEN 'clip 1: confidence: not at most 1' WHEN 5 THEN 'not JSON' WHEN 7 THEN 'clip 1: title: missing' END AS error FROM cj""")
def coerced_plans(spark, d):
    """A model's clip plans, one for each document with clips: defaults filled in, ranges checked, faults named."""
    c, i = _clips(spark, d), F.col("doc_id") % 8
    sec = lambda x: F.floor(x / 15).cast("long")
    first = F.col("place") == 0
    text = lambda n: F.when(i == 3, F.concat(F.lit('"'), n.cast("string"), F.lit('"'))).otherwise(n.cast("string"))
    clip = F.concat(
        F.lit("{"), F.when((i == 7) & first, "").otherwise(F.concat(F.lit('"title":"t'), F.col("place").cast("string"), F.lit('",'))), F.lit('"hook":"h","start_sec":'), text(sec(F.col("start_c"))), F.lit(',"end_sec":'), text(sec(F.col("end_c"))),
        F.lit(',"duration_sec":'), text(sec(F.col("end_c") - F.col("start_c"))), F.lit(',"confidence":'), F.when((i == 4) & first, "1.5").otherwise("1"), F.lit(',"why_it_works":"","add_broll":'), F.when(i == 3, '"true"').otherwise("true"), F.lit(',"broll_query":""}'),
    )
    listed = c.select("doc_id", "place", clip.alias("clip")).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "clip"))), lambda x: x["clip"]), ",").alias("l"))
    made = F.concat(F.lit('{"source_stem":"made","language":"xx","clips":['), "l", F.lit("]}"))
    raw = F.when(i == 1, F.concat(F.lit('{"clips":['), "l", F.lit("]}"))).when(i == 2, F.lit('{"source_stem":"made","language":"xx","clips":"none"}')).when(i == 5, F.concat(F.lit('{"source_stem":"made","clips":['), "l")).when(i == 6, F.concat(F.lit("["), "l", F.lit("]"))).otherwise(made)
    plans = model_output.clip_plans(listed.select("doc_id", F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("stem"), raw.alias("raw")), ["doc_id"])
    seconds = F.when(F.size("clips") > 0, F.aggregate("clips", F.lit(0.0), lambda a, x: a + x["end_sec"] - x["start_sec"]))
    return plans.select("doc_id", "source_stem", "language", F.when(F.col("clips").isNotNull(), F.size("clips").cast("long")).alias("n"), seconds.alias("secs"), F.get("clips", F.lit(0))["visual_mode"].alias("mode"), "error")


@query("WITH " + JOBS + """, e AS (SELECT account, event_id, scheduled_for, CASE WHEN scheduled_for IS NULL THEN 'no time' WHEN scheduled_for = 'soon' THEN 'no time: soon' END AS error FROM jobs)
SELECT account, count(*) AS total, count(*) FILTER (error IS NULL) AS succeeded, string_agg(CAST(event_id AS VARCHAR) || ': ' || error, '; ' ORDER BY event_id) FILTER (error IS NOT NULL) AS errors FROM e GROUP BY account""")
def batch_manifest(spark, d):
    """Each account's jobs as a batch, every job with its own result: a time that can't be read fails that job alone."""
    j = _jobs(spark, d)
    at = F.try_to_timestamp("scheduled_for")
    why = F.when(F.col("scheduled_for").isNull(), "no time").otherwise(F.concat(F.lit("no time: "), "scheduled_for"))
    told = sinks.report(j, ["account", "event_id"], at, at.isNull(), why)
    m = sinks.batch_manifest(told, ["account"], "event_id")
    failed = F.filter("results", lambda r: ~r["ok"])
    return m.select("account", "total", "succeeded", F.nullif(F.array_join(F.transform(failed, lambda r: F.concat(r["event_id"].cast("string"), F.lit(": "), r["error"])), "; "), F.lit("")).alias("errors"))


_ESC = "replace(replace(w, '{', chr(92) || '{'), '}', chr(92) || '}')"


@query("WITH RECURSIVE " + CLIP + "," + WORDS[len(SEG) + 2 :] + f""", cw AS (SELECT k.doc_id, k.place, t.idx, t.pos, t.word, greatest(t.word_start, k.start_c) - k.start_c AS a, least(t.word_end, k.end_c) - k.start_c AS b
  FROM clip k JOIN wt t ON t.doc_id = k.doc_id AND t.word_end > k.start_c AND t.word_start < k.end_c WHERE least(t.word_end, k.end_c) - greatest(t.word_start, k.start_c) > 0),
nw AS (SELECT *, row_number() OVER (PARTITION BY doc_id, place ORDER BY idx, pos) - 1 AS i, row_number() OVER (PARTITION BY doc_id, place, idx ORDER BY pos) - 1 AS nth, a * 100 // 15 AS s, b * 100 // 15 AS e FROM cw),
ln AS (SELECT *, list(word) OVER (PARTITION BY doc_id, place, idx, nth // 6 ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ws FROM nw),
rc AS (SELECT doc_id, place, i, s, greatest(e, s + 4) AS e FROM nw WHERE i = 0
  UNION ALL SELECT n.doc_id, n.place, n.i, CASE WHEN r.e > 0 THEN greatest(n.s, r.e + 3) ELSE n.s END, greatest(n.e, CASE WHEN r.e > 0 THEN greatest(n.s, r.e + 3) ELSE n.s END + 4) FROM rc r JOIN nw n ON n.doc_id = r.doc_id AND n.place = r.place AND n.i = r.i + 1),
tx AS (SELECT l.doc_id, l.place, l.i, r.s, r.e, array_to_string(list_transform(list_reverse(l.ws), lambda w, k: chr(8296) || CASE WHEN k = 1 THEN '{subtitles.ACTIVE}' || {_ESC} || '{{\\rDefault}}' ELSE {_ESC} END || chr(8297)), ' ') AS t FROM ln l JOIN rc r USING (doc_id, place, i)),
tm AS (SELECT *, 'Dialogue: 0,' || (s // 360000) || ':' || lpad(CAST(s // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(s % 100 AS VARCHAR), 2, '0') || ',' ||
  (e // 360000) || ':' || lpad(CAST(e // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(e // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(e % 100 AS VARCHAR), 2, '0') || ',Default,,0,0,0,,{{\\an5\\blur0.8\\bord3.0\\shad1.0}}' || t AS line FROM tx)
SELECT doc_id, place, count(*) AS events, md5('{sinks.ass_header()}' || string_agg(line, chr(10) ORDER BY i) || chr(10)) AS ass_md5 FROM tm GROUP BY ALL""")
def word_subtitles(spark, d):
    """A subtitle document for each clip, an event for each of its words."""
    w = clip_plans.word_times(_seg(spark, d)).withColumnsRenamed({"word_start": "start_c", "word_end": "end_c"})
    s = subtitles.word_subtitles(_clips(spark, d), w)
    events = F.size(F.split("ass", "\nDialogue: ")) - 1
    return s.select("doc_id", "place", events.cast("long").alias("events"), F.md5(F.col("ass").cast("binary")).alias("ass_md5"))
