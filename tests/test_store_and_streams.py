"""Tables changed in place, posting and chunk streams, model answers and manifests: failures, restarts, repeats."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from timbrel.functions import model_output
from timbrel.operators import folds, intervals
from timbrel.queries import QUERIES
from timbrel.sources import sinks
from timbrel.sources.store import Conflict, KeyedTable, shared_folder
from timbrel.streaming import chunks, posting

from .conftest import SF

TWO = "a long, b string, v long"


def table(spark, keys=("a", "b"), buckets=4):
    return KeyedTable(spark, shared_folder(spark, "table"), list(keys), buckets)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, data, schema=TWO):
    return spark.createDataFrame(data, schema)


def test_upserts_and_refreshes_by_key(spark):
    t = table(spark)
    t.write(frame(spark, [(1, "x", 1), (2, "y", 2), (None, "n", 3)]))
    t.upsert(frame(spark, [(2, "y", 20), (None, "n", 30), (4, "z", 40)]))
    assert rows(t.read()) == rows(frame(spark, [(1, "x", 1), (2, "y", 20), (None, "n", 30), (4, "z", 40)]))
    t.refresh(frame(spark, [(1, "x", None), (9, "q", 9)]), ["v"])
    t.refresh(frame(spark, [(4, "z", 99)]), [])
    assert rows(t.read()) == rows(frame(spark, [(1, "x", None), (2, "y", 20), (None, "n", 30), (4, "z", 40), (9, "q", 9)]))
    t.delete(frame(spark, [(2, "y", 0), (9, "q", 0), (77, "none", 0)]))
    assert rows(t.read()) == rows(frame(spark, [(1, "x", None), (None, "n", 30), (4, "z", 40)]))
    assert rows(t.read(version=1)) == rows(frame(spark, [(1, "x", 1), (2, "y", 2), (None, "n", 3)]))
    t.vacuum(1)
    assert t.read().count() == 3 and t._names("versions") == [f"{t.version():012d}"]
    with pytest.raises(Exception):
        t.read(version=1).count()


def test_an_empty_table_can_be_written_and_filled(spark):
    t = table(spark)
    t.write(frame(spark, []))
    assert t.read().count() == 0
    t.upsert(frame(spark, []))
    t.upsert(frame(spark, [(1, "x", 1)]))
    assert rows(t.read()) == [(1, "x", 1)]


def test_a_write_that_dies_leaves_the_old_version(spark):
    t = table(spark)
    t.write(frame(spark, [(i, "x", i) for i in range(50)]))
    before = rows(t.read())
    bad = frame(spark, [(i, "x", -i) for i in range(50)]).withColumn("v", F.when(F.col("a") == 49, F.raise_error(F.lit("disk full")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="disk full"):
        t.upsert(bad)
    assert rows(t.read()) == before and t.version() == 1
    # dies between the data and the version
    publish, t._publish = t._publish, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt())
    with pytest.raises(KeyboardInterrupt):
        t.upsert(frame(spark, [(1, "x", 100)]))
    t._publish = publish
    assert rows(t.read()) == before
    t.upsert(frame(spark, [(1, "x", 100)]))
    t.vacuum()
    assert t.read().count() == 50 and t.read().filter("v = 100").count() == 1


def test_of_two_writers_the_second_gets_an_error(spark):
    t = table(spark)
    t.write(frame(spark, [(1, "x", 1)]))
    other = KeyedTable(spark, t.path, t.keys, t.buckets)
    publish = t._publish
    t._publish = lambda number, text: (other.upsert(frame(spark, [(2, "y", 2)])), publish(number, text))
    with pytest.raises(Conflict):
        t.upsert(frame(spark, [(3, "z", 3)]))
    assert rows(t.read()) == [(1, "x", 1), (2, "y", 2)]


def test_only_touched_buckets_are_written(spark):
    t = table(spark, buckets=16)
    t.write(frame(spark, [(i, "x", i) for i in range(200)]))
    old = t._manifest(None)["folders"]
    t.upsert(frame(spark, [(7, "x", 0)]))
    new = t._manifest(None)["folders"]
    assert sum(old[b] != new[b] for b in old) == 1 and len(old) == len(new)


def test_a_numbered_write_counts_once(spark):
    t = table(spark)
    t.write(frame(spark, [(1, "x", 1)]))
    t.upsert(frame(spark, [(1, "x", 2)]), once=("s", 0))
    t.upsert(frame(spark, [(1, "x", 3)]), once=("s", 0))
    t.upsert(frame(spark, [(1, "x", 4)]), once=("other", 0))
    assert rows(t.read()) == [(1, "x", 4)] and t.done("s") == 0 and t.done("none") == -1
    t.merge(frame(spark, [(1, "x", 0)]), lambda old: old.withColumn("v", F.col("v") + 1), once=("s", 1))
    t.merge(frame(spark, [(1, "x", 0)]), lambda old: old.withColumn("v", F.col("v") + 1), once=("s", 1))
    assert rows(t.read()) == [(1, "x", 5)]


def test_json_is_replaced_whole_or_not(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    sinks.replace_json(spark.range(3), path)
    sinks.replace_json(spark.range(5), path)
    with pytest.raises(Exception):
        sinks.replace_json(spark.range(9).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert spark.read.json(path).count() == 5


# --- posting

JOB = "job_id string, status string, platform string, account string, clip_id long, path string, scheduled_for string, external_post_id string, notes string, updated_at string"
NOW = "2024-01-02T00:00:00"


def posting_tables(spark):
    job = lambda i, status="queued", account="a", path="p", at="2024-01-01T00:00:00", platform="tiktok": (i, status, platform, account, 1, path, at, "", "", "")
    jobs = [job("j1"), job("j2", at=None), job("j3", path=""), job("j4", account="none"), job("j5", at="soon"), job("j6", at="2024-06-01T00:00:00"), job("j7", status="posted"), job("j8", at="2024-01-01T12:00:00"), job("j9", platform="other"), job("k1", platform=None, at="2024-01-01T13:00:00")]
    queue, ledger = table(spark, ["job_id"]), table(spark, ["batch_id", "job_id"])
    queue.write(frame(spark, jobs, JOB))
    return queue, ledger, spark.createDataFrame([("a", "token")], "account string, access_token string")


def states(t):
    return {r.job_id: r.status for r in t.read().collect()}


def test_due_jobs_are_sent_once_and_failures_kept(spark):
    queue, ledger, accounts = posting_tables(spark)
    calls = []

    def send(jobs):
        calls.append(sorted(r.job_id for r in jobs.collect()))
        return posting.sending(lambda row: "post-" + row["job_id"] if row["job_id"] != "j1" else 1 / 0)(jobs)

    run = lambda batch: posting.send_due(queue, ledger, accounts, send, batch, F.lit(NOW).cast("timestamp"), limit=4, at="t")
    run(0)
    assert calls == [["j1", "j2"]]  # j3 has no file, j4 no account
    assert {j: s for j, s in states(queue).items() if s in ("draft_ready", "failed")} == {"j2": "draft_ready", "j1": "failed", "j3": "failed", "j4": "failed"}
    told = {r.job_id: (r.state, r.external_post_id, r.note) for r in ledger.read().collect()}
    assert told["j2"] == ("sent", "post-j2", None) and "division" in told["j1"][2] and told["j3"][2].startswith("missing file") and "account not found" in told["j4"][2]
    before, version = rows(queue.read()), queue.version()
    run(0)  # the same batch again
    assert calls == [["j1", "j2"]] and rows(queue.read()) == before and queue.version() >= version
    run(1)
    assert calls[1:] == [["j8", "k1"]] and states(queue)["j8"] == "draft_ready" and states(queue)["j5"] == states(queue)["j6"] == states(queue)["j9"] == "queued"


def test_a_run_that_dies_while_sending_sends_nothing_twice(spark):
    queue, ledger, accounts = posting_tables(spark)

    def dies(jobs):
        raise RuntimeError("power cut")

    with pytest.raises(RuntimeError):
        posting.send_due(queue, ledger, accounts, dies, 0, F.lit(NOW).cast("timestamp"), limit=2)
    assert set(states(queue).values()) == {"queued", "posted"}
    posting.send_due(queue, ledger, accounts, dies, 0, F.lit(NOW).cast("timestamp"), limit=2)
    assert {r.note for r in ledger.read().collect()} == {posting.INTERRUPTED}
    assert sum(s == "failed" for s in states(queue).values()) == 2


def test_a_job_changed_meanwhile_keeps_its_status(spark):
    queue, ledger, accounts = posting_tables(spark)
    send = posting.sending(lambda row: "x")
    posting.send_due(queue, ledger, accounts, send, 0, F.lit(NOW).cast("timestamp"), limit=1)
    queue.merge(frame(spark, [("j2",)], "job_id string"), lambda old: old.withColumn("status", F.when(F.col("job_id") == "j2", "posted").otherwise(F.col("status"))))
    posting.send_due(queue, ledger, accounts, send, 0, F.lit(NOW).cast("timestamp"), limit=1)
    assert states(queue)["j2"] == "posted"


def test_polling_a_stream_takes_new_jobs_and_runs_by_batch(spark):
    queue, ledger, accounts = posting_tables(spark)
    came, state = shared_folder(spark, "arrivals"), shared_folder(spark, "state")
    new = ("n1", "queued", "tiktok", "a", 2, "p", None, "", "", "")
    for data in ([new], [new, ("j1", "posted", "tiktok", "a", 1, "p", None, "", "", "")]):
        frame(spark, data, JOB).write.mode("append").parquet(came)
        stream = spark.readStream.schema(JOB).parquet(came)
        posting.poll(stream, queue, ledger, accounts, posting.sending(lambda row: "x"), state, F.lit(NOW).cast("timestamp"), limit=1)
    assert states(queue)["n1"] == "draft_ready" and states(queue)["j1"] in ("queued", "draft_ready")  # a known job isn't taken anew
    assert ledger.read().select("batch_id").distinct().count() == 2


CHANGE = "event_id long, job_id string, clip_id long, account string, status string, at timestamp"


def test_status_changes_survive_restarts_and_repeats(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    first = [(1, "a", 1, "x", "queued", at(1)), (2, "a", 1, "x", "posted", at(2)), (3, "b", 2, "y", "posted", at(3))]
    second = [(2, "a", 1, "x", "posted", at(2)), (4, "a", 1, "x", "failed", at(3)), (5, "a", 1, "x", "posted", at(4)), (6, "b", 2, "z", "posted", at(3)), (7, "c", 99, "x", "posted", at(4))]
    came, state, log = shared_folder(spark, "changes"), shared_folder(spark, "state"), shared_folder(spark, "log")
    jobs, pool = table(spark, ["job_id"]), table(spark, ["clip_id"])
    pool.write(spark.createDataFrame([(1, 5, ["w"], None), (2, None, None, None), (3, 0, None, None)], "clip_id long, post_count long, posted_accounts array<string>, last_posted_at timestamp"))
    for data in (first, second):
        frame(spark, data, CHANGE).coalesce(1).write.mode("append").parquet(came)
        posting.apply_changes(spark.readStream.schema(CHANGE).parquet(came), jobs, pool, log, state)
        posting.apply_changes(spark.readStream.schema(CHANGE).parquet(came), jobs, pool, log, state)  # a restart without news
    got = {r.clip_id: (r.post_count, r.posted_accounts) for r in pool.read().collect()}
    assert got == {1: (7, ["w", "x"]), 2: (2, ["y", "z"]), 3: (0, [])}
    assert {r.job_id: r.status for r in jobs.read().collect()} == {"a": "posted", "b": "posted", "c": "posted"}
    moves = {r.event_id: (r.before, r.status) for r in spark.read.parquet(log).collect()}
    assert moves == {1: (None, "queued"), 2: ("queued", "posted"), 3: (None, "posted"), 4: ("posted", "failed"), 5: ("failed", "posted"), 6: ("posted", "posted"), 7: (None, "posted")}


def test_a_batch_applied_before_a_crash_is_not_applied_again(spark):
    came, state, log = shared_folder(spark, "changes"), shared_folder(spark, "state"), shared_folder(spark, "log")
    jobs, pool = table(spark, ["job_id"]), table(spark, ["clip_id"])
    pool.write(spark.createDataFrame([(1, 0, None, None)], "clip_id long, post_count long, posted_accounts array<string>, last_posted_at timestamp"))
    frame(spark, [(1, "a", 1, "x", "posted", datetime(2024, 1, 1))], CHANGE).write.parquet(came)
    upsert, jobs.upsert = jobs.upsert, lambda *a, **b: (_ for _ in ()).throw(RuntimeError("power cut"))  # after the pool was written
    with pytest.raises(Exception):
        posting.apply_changes(spark.readStream.schema(CHANGE).parquet(came), jobs, pool, log, state)
    assert pool.read().first().post_count == 1
    jobs.upsert = upsert
    posting.apply_changes(spark.readStream.schema(CHANGE).parquet(came), jobs, pool, log, state)
    assert pool.read().first().post_count == 1 and jobs.read().count() == 1


# --- chunks


def test_chunks_that_come_one_by_one_make_the_batch_text(spark):
    from timbrel.queries import _read_chunks

    read = _read_chunks(spark, SF).filter("doc_id < 40").select("doc_id", "chunk", "idx", "text", "start_c", "end_c", "keep_start", "keep_end", "last_chunk", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("chunk") * 60).alias("at")).cache()
    came, state = shared_folder(spark, "chunks"), shared_folder(spark, "state")
    kept = table(spark, ["doc_id", "idx"])
    for k in range(4):
        part = read.filter(F.col("chunk") == k) if k < 3 else read.filter("chunk >= 3")
        part.unionByName(part.limit(20)).write.mode("append").parquet(came)  # some come twice
        chunks.collect_segments(spark.readStream.schema(read.schema).parquet(came), kept, state, "2 minutes")
    got = {r.doc_id: (r.text, r.n) for r in chunks.merged(kept.read()).collect()}
    want = {r.doc_id: (r.text, r.n) for r in QUERIES["chunk_merge"](spark, SF).filter("doc_id < 40").collect()}
    assert got == want and intervals.owned_by_midpoint(read).count() == sum(n for _, n in want.values())


# --- model answers


def test_unfenced_answers(spark):
    data = ['```json\n{"a": 1}\n```', '```\n[1]\n```', "```JSON{}```", ' {"a": "```"} ', None, "``", "json"]
    got = [r.v for r in frame(spark, [(x,) for x in data], "t string").select(model_output.unfenced(F.col("t")).alias("v")).collect()]
    assert got == ['{"a": 1}', "[1]", "{}", '{"a": "```"}', "", "``", "json"]


def test_plans_are_completed_or_say_what_is_wrong(spark):
    clip = '{"title":"t","hook":"h","start_sec":0,"end_sec":"9.5","duration_sec":9.5,"confidence":1,"why_it_works":"w","add_broll":"true","broll_query":""%s}'
    data = {
        1: '{"source_stem":"x","language":"ar","clips":[%s]}' % (clip % ',"start_segment_index":3'), 2: '{"clips":{}}', 3: "[1,2]", 4: "17", 5: '{"clips":[', 6: "", 7: None,
        8: '{"clips":[%s,%s]}' % (clip % "", clip.replace('"end_sec":"9.5"', '"end_sec":0') % ""), 9: '{"clips":[7]}', 10: '{"source_stem":5,"clips":[]}', 11: '{"clips":[%s]}' % (clip.replace('"hook":"h",', "") % ',"editorial_score":-0.1'),
    }
    got = {r.id: r for r in model_output.clip_plans(frame(spark, list(data.items()), "id long, raw string").withColumn("stem", F.lit("s")), ["id"]).collect()}
    one = got[1].clips[0]
    assert (got[1].source_stem, got[1].language, got[1].error, one.end_sec, one.add_broll, one.start_segment_index, one.end_segment_index, one.visual_mode) == ("x", "ar", None, 9.5, True, 3, -1, "alternate_scenic")
    for i in (2, 3, 4):
        assert (got[i].source_stem, got[i].language, got[i].clips, got[i].error) == ("s", "Arabic", [], None)
    assert {i: got[i].error for i in (5, 6, 7)} == {5: "not JSON", 6: "not JSON", 7: "not JSON"}
    assert got[8].error == "clip 2: end_sec: not above 0" and got[8].clips is None
    assert got[9].error.startswith("clip 1: not an object") and got[10].error == "source_stem: not string"
    assert got[11].error == "clip 1: hook: missing; clip 1: editorial_score: not at least 0"


def test_refined_texts_fall_back_to_their_own(spark):
    s = frame(spark, [(c, k, f" text {c}{k} ", "kept") for c in range(8) for k in range(3)], "chunk long, local_index long, text string, other string")
    body = lambda x: '{"corrected_segments":[%s]}' % x
    raw = {0: body('{"index":0,"text":" new "},{"index":1,"text":" "},{"index":0,"text":"newer"}'), 1: "```json\n" + body('{"index":"2","text":"two"}') + "\n```", 2: body('{"index":1}'), 3: '{"corrected_segments":{}}', 4: "oops", 5: body('{"index":1.5,"text":"x"}'), 6: body("")}
    got = {(r.chunk, r.local_index): r for r in model_output.refined(s, frame(spark, list(raw.items()), "chunk long, raw string"), ["chunk"]).collect()}
    assert [got[0, k].text for k in range(3)] == ["newer", "text 01", "text 02"] and got[0, 0].used
    assert [got[1, k].text for k in range(3)] == ["text 10", "text 11", "two"]
    assert all(got[c, k].text == f"text {c}{k}" and not got[c, k].used for c in (2, 3, 4, 5, 7) for k in range(3))
    assert {c: got[c, 0].error for c in range(8)} == {0: None, 1: None, 2: "corrected_segments: faulty entry", 3: "corrected_segments: not a list", 4: "not JSON", 5: "corrected_segments: faulty entry", 6: None, 7: "no answer"}
    assert got[6, 0].used and all(r.other == "kept" for r in got.values())


def test_one_bad_item_leaves_the_rest_of_a_batch(spark):
    items = frame(spark, [("s", i) for i in range(4)], "stem string, clip long")
    told = sinks.attempted(items, ["stem", "clip"], lambda row: 12 // row["clip"])
    m = sinks.batch_manifest(told, ["stem"], "clip").first()
    assert (m.total, m.succeeded) == (4, 3) and [r.value for r in m.results] == [None, "12", "6", "4"] and m.results[0].error.startswith("ZeroDivisionError")


def test_beats_clamp_to_the_latest_start_and_fill_gaps(spark):
    got = lambda d, **how: [tuple(r)[2:] for r in folds.schedule_beats(frame(spark, [(1, d)], "k long, d long"), ["k"], "d", **how).orderBy("beat_start").collect()]
    assert got(3000) == [("original", 0, 0, 985, "original_segment"), ("stock_video", 1, 985, 1175, "insert"), ("original", 0, 1175, 2005, "original_segment"), ("stock_video", 2, 2005, 2195, "insert"), ("original", 0, 2195, 3000, "original_outro")]
    # the first may not start before the intro's end and .05
    assert got(600)[:2] == [("original", 0, 0, 205, "original_segment"), ("stock_video", 1, 205, 395, "insert")]
    assert got(400) == [("original", 0, 0, 400, "fallback_original_only")]
    assert got(500)[1] == ("stock_video", 1, 190, 300, "insert")  # clamped to the latest start, which is the intro's end
    assert got(3000, inserts=F.lit(0)) == [("original", 0, 0, 3000, "full_original")]
