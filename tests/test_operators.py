"""Operators on small tables worked out by hand."""

import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from timbrel.functions import likeness
from timbrel.functions import text as X
from timbrel.functions.lexicons import ARABIC, LATIN
from timbrel.operators import catalog, folds, intervals, retrieval, scoring
from timbrel.plans import clips, schedule
from timbrel.sources import readers, sinks
from timbrel.sources.readers import local_date
from timbrel.sources.store import KeyedTable, shared_folder

SEG = "doc_id long, idx long, text string, start_c long, end_c long"


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def scalar(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_words_split_on_unicode_space(spark):
    assert scalar(spark, X.words(F.lit(" a b  c\n"))) == ["a", "b", "c"]
    assert scalar(spark, X.words(F.lit(None).cast("string"))) == []


def test_ngrams(spark):
    assert scalar(spark, X.ngrams(X.words(F.lit("a b c")), 2)) == ["a b", "b c"]
    assert scalar(spark, X.ngrams(X.words(F.lit("a")), 2)) == []


@pytest.mark.parametrize(("text", "starts", "ends"), [("", True, True), ("and so", True, False), ("of the sea", True, False), ("sail to the", False, True), ("ships sail", False, False)])
def test_continuations(spark, text, starts, ends):
    assert scalar(spark, X.starts_with_continuation(F.lit(text), LATIN.starts)) is starts
    assert scalar(spark, X.ends_with_continuation(F.lit(text), LATIN.ends)) is ends


def test_arabic(spark):
    assert scalar(spark, X.starts_with_continuation(F.lit("ثم قال"), ARABIC.starts))
    assert scalar(spark, X.has_payoff(F.lit("هذه رحمة،"), ARABIC.payoff))
    assert scalar(spark, X.fold_arabic(F.lit("ٱلرَّحْمَـٰنِ الأُمّة"))) == "الرحمن الامه"
    assert scalar(spark, X.ends_with_stop(F.lit("لماذا؟ ")))


def test_times(spark):
    assert scalar(spark, X.srt_time(F.lit(3723004))) == "01:02:03,004"
    assert scalar(spark, X.srt_time(F.lit(-5))) == "00:00:00,000"
    assert scalar(spark, X.srt_ms(F.lit("01:02:03,004"))) == 3723004
    assert scalar(spark, X.srt_ms(F.lit("bad"))) == 0
    assert scalar(spark, X.ass_time(F.lit(372300))) == "1:02:03.00"


@pytest.mark.parametrize(("text", "rate"), [("30000/1000", 30.0), ("25", 25.0), ("0/0", 0.0), ("x", 0.0)])
def test_frame_rate(spark, text, rate):
    assert scalar(spark, X.frame_rate(F.lit(text))) == rate


def test_without_terms_takes_the_longest_first(spark):
    assert scalar(spark, X.without_terms(F.lit("a big red car, red"), ["red", "red car"])) == "a big , "[:-1]


def test_char_ratio_is_the_standard_librarys(spark):
    assert scalar(spark, X.char_ratio(F.lit("abcd"), F.lit("bcde"))) == difflib.SequenceMatcher(None, "abcd", "bcde").ratio()


def test_similarity_equals_the_standard_librarys_in_a_fraction_of_its_time():
    rng = random.Random(5)
    text = lambda letters, n: "".join(rng.choices(letters, k=n))
    for _ in range(400):  # from 200 characters on, frequent ones begin no block
        a, b = (text(rng.choice(["ab", "abcdefgh ", "é😀ab ñ"]), rng.choice([0, 1, 7, 60, 199, 200, 330])) for _ in range(2))
        b = b[:20] + a[5:150] + b[20:] if rng.random() < 0.3 else b
        assert likeness.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()
    pairs = [(text("aaabbcdefghijklmnop   ", 3000), text("aaabbcdefghijklmnop   ", 190)) for _ in range(12)]
    times = []
    for f in (likeness.ratio, lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()):
        t = time.process_time()
        times.append(([f(a, b) for a, b in pairs], time.process_time() - t))
    assert times[0][0] == times[1][0] and 3 * times[0][1] < times[1][1]
    assert X.char_ratio.func.__globals__["alike"] is likeness.ratio


def test_slug_and_list(spark):
    assert scalar(spark, X.slug(F.lit("  Über die_See! "))) == "über-die-see"
    assert scalar(spark, X.slug(F.lit("!!"))) == "untitled"
    assert scalar(spark, X.distinct_list(F.array(F.lit(" b"), F.lit(""), F.lit("a"), F.lit("b")))) == ["b", "a"]


def test_pairs_stay_inside_the_band(spark):
    seg = spark.createDataFrame([(1, i, "x", 100 * i, 100 * i + 100) for i in range(6)], SEG)
    got = values(intervals.window_pairs(seg, 200, 300), "start_idx", "end_idx")
    assert got == sorted((a, b) for a in range(6) for b in range(a, 6) if 200 <= 100 * (b - a + 1) <= 300)


def test_as_of_at_and_beyond_the_edges(spark):
    seg = spark.createDataFrame([(1, 0, "x", 0, 10), (1, 1, "x", 10, 20)], SEG)
    pts = spark.createDataFrame([(1, 0), (1, 10), (1, 99)], "doc_id long, t long")
    assert values(intervals.as_of(pts, seg), "t", "first_idx", "last_idx") == [(0, 0, 0), (10, 1, 0), (99, 1, 1)]


def test_adjacent_repeats_compare_with_the_last_kept(spark):
    rows = [(1, 0, "a", 0, 1), (1, 1, "a", 9, 10), (1, 2, "a", 18, 19), (1, 3, "b", 20, 21)]
    assert values(folds.drop_adjacent_repeats(spark.createDataFrame(rows, SEG), 10), "idx") == [(0,), (2,), (3,)]


def test_midpoint_on_the_border_goes_to_the_next_chunk(spark):
    rows = spark.createDataFrame([(0, 20, 0, 10, False), (0, 20, 10, 20, False), (30, 50, 30, 40, True)], "start_c long, end_c long, keep_start long, keep_end long, last_chunk boolean")
    assert values(intervals.owned_by_midpoint(rows), "keep_start") == [(10,), (30,)]


def test_chunks_of_an_exact_multiple_and_of_nothing(spark):
    df = spark.createDataFrame([(1, 20), (2, 0)], "doc_id long, length long")
    assert values(intervals.time_chunks(df, 10, 2), "doc_id", "keep_start", "extract_end") == [(1, 0, 12), (1, 10, 20)]
    with pytest.raises(ValueError):
        intervals.time_chunks(df, 10, 10)


def test_suppression_drops_what_overlaps_any_kept(spark):
    rows = [(1, 0, 1, 0, 100, 9), (1, 1, 2, 25, 125, 8), (1, 2, 3, 31, 131, 7)]
    df = spark.createDataFrame(rows, "doc_id long, start_idx long, end_idx long, start_c long, end_c long, points long")
    assert values(folds.suppress(df, ["doc_id"], [-F.col("points")], 70), "start_idx") == [(0,), (2,)]


def test_tiling_covers_each_row_once(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (1, 2, 1), (1, 3, 1)], "doc_id long, idx long, size long")
    assert values(folds.tile(df, ["doc_id"]), "idx", "size") == [(0, 2), (2, 1), (3, 1)]


def test_gaps_are_filled(spark):
    df = spark.createDataFrame([(1, 100, 0, 30), (1, 100, 60, 70), (2, 50, None, None)], "doc_id long, length long, start_c long, end_c long")
    got = values(folds.fill_gaps(df, ["doc_id"], "length", 10, 5, 3), "doc_id", "kind", "start_c", "end_c")
    assert got == [(1, "insert", 10, 30), (1, "insert", 60, 70), (1, "original", 0, 10), (1, "original", 30, 60), (1, "original", 70, 100), (2, "original", 0, 50)]


def test_eligibility(spark):
    df = spark.createDataFrame(
        [(1, "approved", None, None, None, None), (2, "approved", None, ["a"], ["a"], None), (3, "approved", None, None, ["b"], None), (4, "pending", None, None, None, None), (5, "approved", None, None, [], ["a"])],
        "id long, status string, tags array<string>, blocked_accounts array<string>, allowed_accounts array<string>, posted_accounts array<string>",
    )
    assert values(df.filter(catalog.eligible(F.lit("a"), F.lit(""))), "id") == [(1,)]


def test_due(spark):
    df = spark.createDataFrame([(1, None), (2, "never"), (3, "2024-01-01T00:00:00"), (4, "2025-01-01T00:00:00")], "id long, at string")
    assert values(df.filter(catalog.due(F.col("at"), F.lit("2024-06-01").cast("timestamp"))), "id") == [(1,), (3,)]


def test_slots(spark):
    day, n = F.lit("2024-03-10").cast("date"), F.lit
    assert scalar(spark, catalog.slots(day, n(4), 0, 24)) == ["2024-03-10T03:00:00", "2024-03-10T09:00:00", "2024-03-10T15:00:00", "2024-03-10T21:00:00"]
    assert scalar(spark, catalog.slots(day, n(0))) == []
    assert scalar(spark, catalog.slots(day, n(2), 8, 22, "America/New_York")) == ["2024-03-10T11:30:00-04:00", "2024-03-10T18:30:00-04:00"]
    assert scalar(spark, catalog.slots(F.lit("2024-01-10").cast("date"), n(2), 8, 22, "Asia/Kolkata"))[0] == "2024-01-10T11:30:00+05:30"
    from datetime import datetime, timedelta

    for per_day in (1, 3, 7, 11, 13):
        step = 14 * 3600 / per_day
        want = [(datetime(2024, 3, 10, 8) + timedelta(seconds=step * (i + 0.5))).isoformat() for i in range(per_day)]
        assert scalar(spark, catalog.slots(day, n(per_day))) == want
    for hours in ((-1, 5), (24, 24), (8, 8), (9, 25)):
        with pytest.raises(ValueError):
            catalog.slots(day, n(1), *hours)


def test_clips_by_number(spark):
    c = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id long, place long, t string")
    assert values(readers.clip_at(c, 1), "t") == [("a",), ("c",)] and values(readers.clip_at(c.filter("doc_id = 1"), 2), "t") == [("b",)]
    with pytest.raises(ValueError):
        readers.clip_at(c, 0)
    with pytest.raises(IndexError, match="no clip 3; the last is 2"):
        readers.clip_at(c, 3)


def test_renditions_by_preference(spark):
    rows = [(1, 1, 100, 200, "x"), (1, 2, 300, 400, "x"), (1, 3, 900, 300, "x"), (1, 4, 999, 9999, " "), (2, 5, 500, 500, "x"), (2, 6, 700, 100, "x"), (3, 7, 10, 20, "x"), (3, 8, 30, 60, "x"), (4, 9, 5, 5, None)]
    f = spark.createDataFrame(rows, "q long, file_id long, width long, height long, link string")
    got = lambda **how: dict(values(catalog.best_rendition(f, ["q"], **how), "q", "file_id"))
    assert got() == {1: 2, 2: 5, 3: 8}
    assert got(prefer_portrait=False) == {1: 3, 2: 5, 3: 8}
    assert got(allow_landscape=False) == {1: 2, 2: 5, 3: 8} and got(prefer_portrait=False, allow_landscape=False) == {1: 2, 2: 5, 3: 8}
    # tiers instead of areas: the lower file id is the higher tier
    assert got(order=-F.col("file_id")) == {1: 1, 2: 5, 3: 7}


def test_errors_of_the_providers_that_were_asked(spark):
    rows = [(1, "a", 0, "timeout"), (1, "b", 2, None), (1, "c", 0, "never asked"), (2, "a", 0, None), (2, "b", 0, "no key"), (2, "c", 0, "gone"), (3, "a", 1, None)]
    f = spark.createDataFrame(rows, "q long, provider string, found long, error string")
    got = {r.q: r.errors for r in catalog.provider_errors(f, ["q"], F.col("provider")).collect()}
    assert got == {1: ["a: timeout"], 2: ["b: no key", "c: gone"], 3: []}


def test_events_pushed_apart(spark):
    import random

    rnd = random.Random(4)
    rows = [(k, i, s, s + rnd.randint(0, 30)) for k in range(3) for i in range(400) for s in [i * 9 + rnd.randint(0, 40)]]
    got = {(r.k, r.idx): (r.start_c, r.end_c) for r in folds.separate(spark.createDataFrame(rows, "k long, idx long, start_c long, end_c long"), ["k"], 3, 4).collect()}
    for k in range(3):
        last = 0
        for _, i, s, e in [r for r in rows if r[0] == k]:
            s = max(s, last + 3) if last > 0 else s
            last = max(e, s + 4)
            assert got[k, i] == (s, last)
    with pytest.raises(ValueError):
        folds.separate(spark.range(1), ["id"], 1, 0)


def test_long_documents_of_repeats_stay_linear(spark):
    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("idx"), (F.col("id") % 7).cast("string").alias("text"), (F.col("id") * 3).alias("start_c"), (F.col("id") * 3 + 2).alias("end_c"))
    assert folds.drop_adjacent_repeats(rows, 15).count() == 100_000
    assert folds.separate(rows, ["doc_id"], 2, 4).agg(F.max("end_c")).first()[0] == 2 + 99_999 * 6 + 2
    windows = rows.filter("idx % 2 = 0").select("doc_id", "idx", F.lit(3).cast("long").alias("size"))
    assert folds.tile_accepted(windows, ["doc_id"]).count() == 25_000


def test_local_dates(spark):
    df = spark.createDataFrame([("2024-01-10T03:00:00+00:00",), ("2024-01-10T03:00:00-05:00",), ("2024-01-10T23:59:59-05:00",), ("2024-07-01T04:00:00Z",), ("soon",), (None,)], "t string")
    got = [str(r.d) for r in df.select(local_date(F.col("t"), "America/New_York").alias("d")).collect()]
    assert got == ["2024-01-09", "2024-01-10", "2024-01-10", "2024-07-01", "None", "None"]


def _catalogue(spark):
    none = "array<string>"
    c = spark.createDataFrame([(i, f"s{i % 2}", "approved", ["dua"] if i else None, None, None, None) for i in range(6)], f"clip_id long, source string, status string, tags {none}, blocked_accounts {none}, allowed_accounts {none}, posted_accounts {none}")
    j = spark.createDataFrame([(0, "a", "cancelled", "2024-01-01T10:20:00-05:00"), (1, "a", "queued", "2024-01-01T23:30:00-05:00"), (2, "a", None, None)], "clip_id long, account string, status string, scheduled_for string")
    return c, j


def test_a_day_keeps_closed_slots_and_counts_open_jobs(spark):
    c, j = _catalogue(spark)
    plan = schedule.daily_plan(c, j, "a", "2024-01-01", per_day=3, seed="x").orderBy("scheduled_for").collect()
    assert [r.scheduled_for for r in plan] == ["2024-01-01T15:00:00-05:00", "2024-01-01T19:40:00-05:00"]  # of three the first is the cancelled job's
    assert all(r.clip_id != 1 and (r.status, r.platform, r.account, r.notes) == ("queued", "tiktok", "a", "") for r in plan)
    assert all(r.hashtags == ["#islam", "#muslim", "#reminder"] + ["#dua"] * (r.clip_id > 0) for r in plan)
    # half an hour before midnight there is the next day elsewhere
    assert schedule.daily_plan(c, j, "a", "2024-01-02", per_day=3, zone="UTC", seed="x").count() == 2
    assert len({r.source for r in schedule.daily_plan(c, j, "a", "2024-01-02", per_day=2, seed="x").collect()}) == 2
    tagged = schedule.daily_plan(c, j, "a", "2024-01-03", per_day=9, tag="dua", seed="x").collect()
    assert {r.clip_id for r in tagged} == {1, 2, 3, 4, 5}
    with pytest.raises(ValueError):
        schedule.daily_plan(c, j, " ", "2024-01-01")


def test_days_share_no_clip(spark):
    c, j = _catalogue(spark)
    got = schedule.several_days(c, j, "b", ["2024-01-01", "2024-01-02"], per_day=2, seed="x").collect()
    assert len({r.clip_id for r in got}) == len(got) == 4
    assert len({(r.scheduled_for[:10], r.source) for r in got}) == 4
    # a day with an open job needs one less, and what a full day doesn't need goes to the next
    two = schedule.several_days(c, j, "a", ["2024-01-01", "2024-01-02"], per_day=1, seed="x").collect()
    assert [r.scheduled_for[:10] for r in two] == ["2024-01-02"] and two[0].clip_id != 1
    one = schedule.several_days(c, j, "b", ["2024-01-05"], per_day=2, seed="x").select("clip_id", "scheduled_for").collect()
    assert sorted(one) == sorted(schedule.daily_plan(c, j, "b", "2024-01-05", per_day=2, seed="x").select("clip_id", "scheduled_for").collect())


def test_a_plan_of_more_days_grows_in_proportion(spark):
    c, j = _catalogue(spark)
    size = lambda n: schedule.several_days(c, j, "b", [f"2024-01-{k:02d}" for k in range(1, n + 1)], per_day=1)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(12) == size(2)


def test_match_score_and_acceptance(spark):
    s = retrieval.match_score(*[F.lit(x) for x in (1.0, 1.0, 1.0, 1.0)], F.lit(True), F.lit(1.0), F.lit(False))
    assert scalar(spark, s) == 1.0
    yes = retrieval.accepted(F.lit(0.7), F.lit(0.1), F.lit(0.6), F.lit(0.3), F.lit(2), F.lit(True), 0.6, 0.05)
    no = retrieval.accepted(F.lit(0.7), F.lit(0.1), F.lit(0.6), F.lit(0.1), F.lit(2), F.lit(True), 0.6, 0.05)
    assert scalar(spark, yes) and not scalar(spark, no)


def test_bag_overlap_keeps_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "a long, token string")
    b = spark.createDataFrame([(2, "x"), (2, "x"), (2, "x"), (3, "z")], "b long, token string")
    p = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert values(retrieval.bag_overlap(p, a, b, "a", "b"), "b", "common") == [(2, 2), (3, 0)]


def test_asset_rules_at_their_limits(spark):
    df = spark.createDataFrame([(1, 720, 1280, 1200, 20, 120000), (2, 1079, 1000, 1199, 19, 119999), (3, 0, 5, 0, 0, 0)], "id long, w long, h long, ms long, fps long, sz long")
    score, flags = scoring.asset_rules(F.lit(True), *[F.col(c) for c in ("w", "h", "ms", "fps", "sz")])
    assert values(df.select("id", score.alias("s"), flags.alias("f")), "id", "s", "f") == [
        (1, 100, ""), (2, 40, "resolution_below_1080,not_portrait,very_short_video,low_frame_rate,small_file_size"), (3, 40, "could_not_read_dimensions,duration_missing,small_file_size"),
    ]


def test_two_beats_and_crossfades(spark):
    df = spark.createDataFrame([(1, 30), (2, 300)], "id long, d long")
    assert values(clips.two_beats(df, "d"), "id", "kind", "beat_start", "beat_end") == [(1, "original", 0, 30), (2, "original", 0, 45), (2, "stock_video", 45, 300)]
    b = spark.createDataFrame([(1, 0, 1000), (1, 1, 200), (1, 2, 1000)], "k long, idx long, ms long")
    assert values(clips.crossfades(b, "k", 500), "idx", "fade_ms", "offset_ms") == [(1, 100, 900), (2, 100, 1000)]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\nHello\nworld\n\n2\n00:00:03,000 --> 00:00:04,000\n\n\n3\n00:00:05,000 --> 00:00:06,000\nend\n")
    cues = readers.srt(spark, str(tmp_path / "a.srt"))
    assert values(cues, "idx", "start_ms", "end_ms", "text") == [(0, 1000, 2500, "Hello world"), (1, 5000, 6000, "end")]
    assert sinks.srt_text(cues, ["path"]).first().srt == "1\n00:00:01,000 --> 00:00:02,500\nHello world\n\n2\n00:00:05,000 --> 00:00:06,000\nend\n"
    (tmp_path / "k.txt").write_text("﻿# c\n1|1|a|b\n\n1|2|x\n1\t2\ty\n", encoding="utf-8")
    assert values(readers.keyed_text(spark, str(tmp_path / "k.txt")), "key", "text") == [("1:1", "a|b"), ("1:2", "y")]
    (tmp_path / "more").mkdir()
    for name, lines in (("a.txt", "1|1|first\n1|1|second"), ("b.txt", "1|1|third\n2|1|x\n1|1|last"), ("c.txt", "# none")):
        (tmp_path / "more" / name).write_text(lines)
    assert values(readers.keyed_text(spark, str(tmp_path / "more")), "key", "text") == [("1:1", "last"), ("2:1", "x")]
    made = str(tmp_path / "made.json")
    assert readers.json_documents(spark, made, "a long, b string", default={"a": 7, "b": "ü"}).first() == (7, "ü")
    assert readers.json_documents(spark, made, "a long, b string", default={"a": 8}).first() == (7, "ü")
    with pytest.raises(Exception):
        readers.json_documents(spark, str(tmp_path / "none.json"), "a long").count()
    (tmp_path / "d.json").write_text('{"a": 1,\n "b": "x"}')
    assert readers.json_documents(spark, str(tmp_path / "d.json"), "a long, b string").first().b == "x"
    assert readers.files(spark, str(tmp_path), "*.srt", 5).count() == 1
    sinks.append_history(spark.range(2), str(tmp_path / "h"))
    sinks.append_history(spark.range(3), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 5
    sinks.replace_json(spark.range(2), str(tmp_path / "j"))
    sinks.replace_json(spark.range(1), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_a_bad_line_raises(spark, tmp_path):
    (tmp_path / "k.txt").write_text("1|2\n")
    with pytest.raises(Exception, match="bad line"):
        readers.keyed_text(spark, str(tmp_path / "k.txt")).collect()


def test_cascade_and_upsert(spark):
    a, b = spark.createDataFrame([(1, "a")], "k long, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k long, v string")
    assert values(readers.first_available([("a", a), ("b", b)], ["k"]), "k", "v", "source_name") == [(1, "a", "a"), (2, "b", "b")]
    assert values(sinks.upsert(b, a, ["k"]), "k", "v") == [(1, "a"), (2, "b")]


def test_segments_of_null_and_blank_texts(spark):
    df = spark.createDataFrame([(1, None), (2, " \n"), (3, " ab \n\ncd")], "doc_id long, text string")
    assert values(readers.segments(df), "doc_id", "idx", "text", "start_c", "end_c") == [(3, 0, "ab", 0, 2), (3, 1, "cd", 2, 4)]


def test_plans_prune_and_push(spark):
    from .conftest import SF

    df = readers.table(spark, SF, "documents").filter("lang = 'en'").select("doc_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_ass_document(spark):
    from timbrel.sources import sinks

    rows = [(1, 0, 0, 150, "a {b}"), (1, 1, 150, 300, "c\nd"), (1, 2, 300, 400, "  ")]
    r = sinks.ass_text(spark.createDataFrame(rows, "k long, idx long, start_cs long, end_cs long, text string"), ["k"], sinks.ass_header(), right_to_left=True).first()
    lines = r.ass.split("\n")
    assert lines[0] == "[Script Info]" and lines[-1] == "" and lines[-3] == "Dialogue: 0,0:00:00.00,0:00:01.50,Default,,0,0,0,,\u202Ba \\{b\\}\u202C"
    assert lines[-2].endswith("\u202Bc\u202C\\N\u202Bd\u202C")


def test_text_files_keep_their_lines(spark, tmp_path):
    from timbrel.sources import sinks

    sinks.text_files(spark.createDataFrame([("x", "1\n2\n3"), ("y", "4")], "n string, t string"), str(tmp_path / "o"), "n", "t")
    (part,) = (tmp_path / "o" / "n=x").glob("part-*")
    assert part.read_text() == "1\n2\n3\n"


def test_a_dry_run_writes_the_plan_alone(spark):
    c, j = _catalogue(spark)
    plan = schedule.daily_plan(c, j, "a", "2024-01-01", per_day=3, seed="x", at="now")
    for dry in (False, True):
        out, plans, history = schedule.record_day(plan, j, None, "a", "2024-01-01", "now", dry, per_day=3)
        assert out.count() == (3 if dry else 5)
        row = plans.first()
        assert (row.plan_key, row.target, row.existing, row.created, row.unfilled, row.start_hour, row.dry_run) == ("a__2024-01-01", 3, 1, 2, 0, 8, dry)
        assert [x.scheduled_for[11:16] for x in row.jobs] == ["15:00", "19:40"]
        assert sorted(r.type for r in history.collect()) == ["daily_schedule_run"] + ["scheduled_job_created"] * (0 if dry else 2)


def test_a_written_day_is_not_planned_twice(spark):
    c, j = _catalogue(spark)
    queue, plans, log = KeyedTable(spark, shared_folder(spark, "q"), ["job_id"], 4), KeyedTable(spark, shared_folder(spark, "p"), ["plan_key"], 4), shared_folder(spark, "h")
    queue.write(schedule.as_jobs(c.filter("clip_id = 5").withColumn("slot", F.lit("2024-01-01T08:00:00-05:00")), "a", "tiktok", "old"))
    assert schedule.write_day(c, queue, plans, log, "a", "2024-01-01", "1", dry_run=True, per_day=3) == 2 and queue.read().count() == 1
    assert schedule.write_day(c, queue, plans, log, "a", "2024-01-01", "2", per_day=3) == 2 and queue.read().count() == 3
    assert schedule.write_day(c, queue, plans, log, "a", "2024-01-01", "3", per_day=3) == 0 and queue.read().count() == 3
    row = plans.read().first()
    assert plans.read().count() == 1 and (row.existing, row.created, row.updated_at) == (3, 0, "3")
    assert spark.read.parquet(log).groupBy("type").count().collect() and spark.read.parquet(log).filter("type = 'scheduled_job_created'").count() == 2


def test_editorial_rules(spark):
    from timbrel.operators import scoring

    row = spark.createDataFrame([(5000, 5300, 5300, 4000, 5000, 4500, 900)], "beginning long, ending long, standalone long, prior long, following long, resolution long, length long")
    parts = (10 * 5000 + 23 * 5000 + 23 * 5300 + 18 * 5300 + 10 * 6000 + 8 * 5000 + 5 * 4500 + 3 * 10000) // 100
    r = row.select(
        scoring.editorial(F.lit(5000), F.lit(10000), F.col("length")).alias("p"), scoring.in_range(F.lit(7), F.col("length"), 300, 885).alias("out"),
        scoring.editorial_notes(F.lit("and so it goes on"), F.lit("thus it ends."), F.lit("before"), F.col("length")).alias("notes"),
    ).first()
    assert r.p == parts - 1200 - 1400 - 1400 - 600 - 5000 and r.out == -1
    assert r.notes == ["starts_like_continuation", "previous_segment_not_closed", "clean_terminal_punctuation", "ending_contains_payoff_signal", "weak_beginning_completeness", "weak_ending_completeness", "depends_on_following_context", "limited_resolution", "over_59_seconds"]


def test_dealt_partitions_grow_with_the_rows_and_steps_within_a_key_stay(spark):
    from timbrel.plans import clips
    from timbrel.sources import readers

    docs = spark.range(100).selectExpr("id AS doc_id", "concat('one two', char(10), 'three ', id) AS text")
    dealt = readers.dealt(docs, "doc_id", 10)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 100
    words = clips.word_times(readers.segments(dealt))
    assert words.count() == 400
    assert words._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_candidates_and_starts_of_a_small_corpus_move_the_sources_once(spark):
    from timbrel.operators import retrieval
    from timbrel.sources import readers

    docs = readers.dealt(spark.createDataFrame([(i, f"w{i % 7} x{i % 5} y w{i % 3}") for i in range(50)], "doc_id long, text string"), "doc_id")
    items = spark.createDataFrame([(i, f"w{i} x{i} z") for i in range(6)], "item_id long, text string")
    tok = lambda df, key: retrieval.tokens(df, key, F.col("text"))
    idf = retrieval.with_idf(retrieval.document_frequency(tok(items, "item_id"), "item_id"), 6)
    got = retrieval.candidates(tok(docs, "doc_id"), tok(items, "item_id"), idf, "doc_id", "item_id", 2)
    starts = retrieval.fragment_starts(tok(items, "item_id"), tok(docs, "doc_id"), idf, "item_id", "doc_id")
    for df in (got, starts):
        assert df.count() > 50
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "Exchange hashpartitioning(item_id, doc_id" not in plan and ", doc_id#" not in "".join(x for x in plan.split("\n") if "Exchange" in x)
