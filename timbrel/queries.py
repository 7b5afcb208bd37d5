"""Queries over the driver's tables, each with an independent DuckDB statement where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as X
from .functions.lexicons import LATIN
from .operators import catalog, folds, intervals, retrieval, scoring
from .plans import clips, schedule
from .sources import readers, sinks
from .sources.readers import segments, table
from .sources.store import KeyedTable, shared_folder
from .streaming import history

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- views -------------------------------------------------------------------------------

SEG = r"""raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents
), tl AS (
  SELECT doc_id, k, trim(line, ' ') AS text FROM raw WHERE trim(line, ' ') <> ''
), seg AS (
  SELECT doc_id, row_number() OVER w - 1 AS idx, text, CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS start_c, CAST(sum(length(text)) OVER w AS BIGINT) AS end_c
  FROM tl WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""
WIN = SEG + r""", pairs AS (
  SELECT a.doc_id, a.idx AS start_idx, b.idx AS end_idx, a.start_c, b.end_c, b.text AS last_text
  FROM seg a JOIN seg b ON a.doc_id = b.doc_id AND b.idx >= a.idx AND b.end_c - a.start_c BETWEEN 300 AND 885
), scored AS (
  SELECT doc_id, start_idx, end_idx, start_c, end_c,
         CAST(greatest(0, 10000 - floor(10000 * abs(end_c - start_c - 630) / 240)) AS BIGINT) + CASE WHEN regexp_matches(last_text, '[.!?]$') THEN 1800 ELSE 0 END AS points
  FROM pairs
)"""
CLIP = WIN + r""", ordered AS (
  SELECT doc_id, list({'start_idx': start_idx, 'end_idx': end_idx, 'start_c': start_c, 'end_c': end_c, 'points': points} ORDER BY points DESC, start_idx, end_idx) AS l FROM scored GROUP BY doc_id
), kept AS (
  SELECT doc_id, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: 100 * (least(x[1].end_c, y.end_c) - greatest(x[1].start_c, y.start_c)) >= 70 * least(x[1].end_c - x[1].start_c, y.end_c - y.start_c))) > 0 THEN a ELSE list_concat(a, x) END) AS k
  FROM ordered
), clip AS (
  SELECT doc_id, CAST(p - 1 AS BIGINT) AS place, k[p].start_idx AS start_idx, k[p].end_idx AS end_idx, k[p].start_c AS start_c, k[p].end_c AS end_c, k[p].points AS points
  FROM (SELECT doc_id, k, unnest(range(1, len(k) + 1)) AS p FROM kept)
)"""


def _seg(spark, d, each=2000):
    """Segments of all documents, dealt by document: steps within a document need no exchange, and a task's share (``each`` documents) doesn't grow with the table."""
    return segments(readers.dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id", each))


def _clips(spark, d):
    return clips.find_clips(_seg(spark, d))


@query("WITH " + SEG + " SELECT doc_id, idx, text, start_c, end_c FROM seg")
def segments_from_documents(spark, d):
    return _seg(spark, d)


@query("WITH " + CLIP + " SELECT * FROM clip")
def clip_candidates(spark, d):
    return _clips(spark, d)


@query("WITH " + CLIP + " SELECT doc_id, start_idx, end_idx, points FROM clip ORDER BY points DESC, doc_id, start_idx LIMIT 50")
def clip_candidates_topk(spark, d):
    return _clips(spark, d).orderBy(F.desc("points"), "doc_id", "start_idx").limit(50).select("doc_id", "start_idx", "end_idx", "points")


@query("WITH " + SEG + " SELECT doc_id, idx, text, coalesce(lag(text) OVER w, '') AS prev_text, coalesce(lead(text) OVER w, '') AS next_text FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY idx)")
def segment_neighbours(spark, d):
    return intervals.neighbours(_seg(spark, d)).select("doc_id", "idx", "text", "prev_text", "next_text")


@query("WITH " + CLIP + " SELECT c.doc_id, c.place, s.idx, s.start_c AS seg_start, s.end_c AS seg_end FROM clip c JOIN seg s ON s.doc_id = c.doc_id AND s.end_c > c.start_c AND s.start_c < c.end_c")
def clip_segment_overlap(spark, d):
    return intervals.overlapping(_clips(spark, d), _seg(spark, d)).select("doc_id", "place", "idx", "seg_start", "seg_end")


@query("WITH " + CLIP + """, span AS (SELECT c.doc_id, c.place, min(s.idx) AS lo, max(s.idx) AS hi FROM clip c JOIN seg s ON s.doc_id = c.doc_id AND s.end_c > c.start_c AND s.start_c < c.end_c GROUP BY ALL)
SELECT p.doc_id, p.place, s.idx, s.text, s.idx BETWEEN lo AND hi AS inside FROM span p JOIN seg s ON s.doc_id = p.doc_id AND s.idx BETWEEN lo - 2 AND hi + 2""")
def clip_segment_padding(spark, d):
    return intervals.padded(_clips(spark, d), _seg(spark, d), ["doc_id", "place"], 2)


@query("WITH " + SEG + """, p AS (SELECT doc_id, unnest([0, 100, 450, 2000]) AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM seg))
SELECT p.doc_id, CAST(p.t AS BIGINT) AS t, coalesce((SELECT min(idx) FROM seg s WHERE s.doc_id = p.doc_id AND s.end_c > p.t), (SELECT max(idx) FROM seg s WHERE s.doc_id = p.doc_id)) AS first_idx,
       coalesce((SELECT max(idx) FROM seg s WHERE s.doc_id = p.doc_id AND s.start_c < p.t), 0) AS last_idx FROM p""")
def asof_first_last_segment(spark, d):
    seg = _seg(spark, d)
    pts = seg.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 100, 450, 2000)])).alias("t"))
    return intervals.as_of(pts, seg).select("doc_id", "t", "first_idx", "last_idx")


@query("WITH " + SEG + """, n AS (SELECT doc_id, count(*) AS n FROM seg GROUP BY doc_id), w AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 22 THEN 1 ELSE CAST(ceil((n - 22) / 14) AS BIGINT) + 1 END)) AS win FROM n)
SELECT doc_id, win, win * 14 AS lo, least(win * 14 + 22, n) - 1 AS hi FROM w""")
def count_windows(spark, d):
    return intervals.count_windows(_seg(spark, d), 22, 14)


CHUNK = SEG + """, len AS (SELECT doc_id, max(end_c) AS length FROM seg GROUP BY doc_id), ch AS (
  SELECT doc_id, length, unnest(range(0, CAST(ceil(length / 900) AS BIGINT))) AS chunk FROM len), chunks AS (
  SELECT doc_id, chunk, chunk * 900 AS keep_start, least((chunk + 1) * 900, length) AS keep_end, greatest(chunk * 900 - 120, 0) AS extract_start, least((chunk + 1) * 900 + 120, length) AS extract_end, length FROM ch)"""


def _chunks(spark, d):
    n = _seg(spark, d).groupBy("doc_id").agg(F.max("end_c").alias("length"))
    return intervals.time_chunks(n, 900, 120), n


@query("WITH " + CHUNK + " SELECT doc_id, chunk, keep_start, keep_end, extract_start, extract_end FROM chunks")
def time_chunks(spark, d):
    return _chunks(spark, d)[0]


def _read_chunks(spark, d):
    """What each chunk's transcription would hold: the segments that overlap its extract."""
    ch, n = _chunks(spark, d)
    ch = ch.join(n, "doc_id").withColumn("last_chunk", F.col("keep_end") >= F.col("length"))
    s = _seg(spark, d).withColumnRenamed("doc_id", "_d")
    return ch.join(s, (F.col("doc_id") == F.col("_d")) & (F.col("end_c") > F.col("extract_start")) & (F.col("start_c") < F.col("extract_end"))).drop("_d")


OWN = CHUNK + """, own AS (SELECT c.doc_id, c.chunk, s.idx, s.text, s.start_c, s.end_c,
  (s.start_c + s.end_c >= 2 * c.keep_start) AND (c.keep_end >= c.length OR s.start_c + s.end_c < 2 * c.keep_end) AS owned
  FROM chunks c JOIN seg s ON s.doc_id = c.doc_id AND s.end_c > c.extract_start AND s.start_c < c.extract_end)"""


@query("WITH " + OWN + " SELECT doc_id, chunk, idx FROM own WHERE owned")
def chunk_ownership(spark, d):
    return intervals.owned_by_midpoint(_read_chunks(spark, d)).select("doc_id", "chunk", "idx")


@query("WITH " + OWN + " SELECT doc_id, chunk, count(*) AS n_raw, count(*) FILTER (owned) AS n_accepted FROM own GROUP BY ALL")
def chunk_report(spark, d):
    raw = _read_chunks(spark, d)
    owned = intervals.owned_by_midpoint(raw).select("doc_id", "chunk", "idx", F.lit(1).alias("ok"))
    return raw.join(owned, ["doc_id", "chunk", "idx"], "left").groupBy("doc_id", "chunk").agg(F.count("*").alias("n_raw"), F.count("ok").alias("n_accepted"))


@query("WITH " + OWN + " SELECT doc_id, string_agg(text, ' ' ORDER BY idx) AS text, count(*) AS n FROM own WHERE owned GROUP BY doc_id")
def chunk_merge(spark, d):
    own = intervals.owned_by_midpoint(_read_chunks(spark, d))
    listed = F.sort_array(F.collect_list(F.struct("idx", "text")))
    return own.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias("text"), F.count("*").alias("n"))


# repeats need near times: the clock is slowed to a tenth, so that neighbours lie close
@query("WITH RECURSIVE " + SEG + """, z AS (SELECT doc_id, idx, text, start_c // 10 AS start_c, end_c // 10 AS end_c FROM seg), r AS (
  SELECT doc_id, idx, text, start_c, end_c, true AS keep, text AS lt, start_c AS ls, end_c AS le FROM z WHERE idx = 0
  UNION ALL
  SELECT z.doc_id, z.idx, z.text, z.start_c, z.end_c, NOT q, CASE WHEN q THEN lt ELSE z.text END, CASE WHEN q THEN ls ELSE z.start_c END, CASE WHEN q THEN le ELSE z.end_c END
  FROM (SELECT r.*, z.text = r.lt AND abs(z.start_c - r.ls) < 15 AND abs(z.end_c - r.le) < 15 AS q FROM r JOIN z ON z.doc_id = r.doc_id AND z.idx = r.idx + 1) r JOIN z ON z.doc_id = r.doc_id AND z.idx = r.idx + 1)
SELECT doc_id, idx, text, start_c, end_c FROM r WHERE keep""")
def adjacent_dedup(spark, d):
    s = _seg(spark, d).select("doc_id", "idx", "text", F.floor(F.col("start_c") / 10).cast("long").alias("start_c"), F.floor(F.col("end_c") / 10).cast("long").alias("end_c"))
    return folds.drop_adjacent_repeats(s, 15)


@query("WITH RECURSIVE " + SEG + """, r AS (
  SELECT doc_id, idx, CAST(0 AS BIGINT) AS chunk, CAST(1 AS BIGINT) AS n, CAST(length(text) + 4 AS BIGINT) AS c FROM seg WHERE idx = 0
  UNION ALL
  SELECT s.doc_id, s.idx, r.chunk + CASE WHEN fresh THEN 1 ELSE 0 END, CASE WHEN fresh THEN 1 ELSE r.n + 1 END, CASE WHEN fresh THEN sz ELSE r.c + sz END
  FROM (SELECT r.*, length(s.text) + 3 + length(CAST(r.n + 1 AS VARCHAR)) AS sz, r.n >= 6 OR r.c + length(s.text) + 3 + length(CAST(r.n + 1 AS VARCHAR)) > 900 AS fresh FROM r JOIN seg s ON s.doc_id = r.doc_id AND s.idx = r.idx + 1) r
  JOIN seg s ON s.doc_id = r.doc_id AND s.idx = r.idx + 1)
SELECT doc_id, idx, chunk FROM r""")
def bounded_chunks(spark, d):
    return folds.bounded_chunks(_seg(spark, d), 6, 900)


@query("WITH " + SEG + " SELECT doc_id, idx, idx // 4 AS chunk FROM seg")
def fixed_chunks(spark, d):
    return folds.fixed_chunks(_seg(spark, d), 4).select("doc_id", "idx", "chunk")


# a window's size is the best of 1..3 by how near its length comes to 240; its first segment absorbs the others
TILE = SEG + """, cand AS (SELECT a.doc_id, a.idx, b.idx - a.idx + 1 AS size, abs(b.end_c - a.start_c - 240) AS miss FROM seg a JOIN seg b ON a.doc_id = b.doc_id AND b.idx BETWEEN a.idx AND a.idx + 2),
best AS (SELECT doc_id, idx, CASE WHEN min(miss) <= 150 THEN arg_min(size, miss * 10 + size) ELSE 1 END AS size FROM cand GROUP BY ALL), tile AS (
  SELECT doc_id, idx, size FROM best WHERE idx = 0
  UNION ALL
  SELECT b.doc_id, b.idx, b.size FROM tile t JOIN best b ON b.doc_id = t.doc_id AND b.idx = t.idx + t.size)"""


def _tiles(spark, d):
    s = _seg(spark, d)
    e = s.select(F.col("doc_id").alias("_d"), F.col("idx").alias("_i"), F.col("end_c").alias("_e"))
    c = s.withColumn("size", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)])))
    c = c.join(e, (F.col("doc_id") == F.col("_d")) & (F.col("_i") == F.col("idx") + F.col("size") - 1)).withColumn("miss", F.abs(F.col("_e") - F.col("start_c") - 240))
    best = c.groupBy("doc_id", "idx").agg(F.when(F.min("miss") <= 150, F.min_by("size", F.struct("miss", "size"))).otherwise(F.lit(1).cast("long")).alias("size"))
    return s, folds.tile(best, ["doc_id"])


@query("WITH RECURSIVE " + TILE + " SELECT doc_id, idx, size FROM tile")
def greedy_tiling(spark, d):
    return _tiles(spark, d)[1]


@query("WITH RECURSIVE " + TILE + """ SELECT s.doc_id, s.idx, s.idx > t.idx AS absorbed, CASE WHEN s.idx = t.idx THEN e.end_c ELSE s.end_c END AS end_c,
  CASE WHEN s.idx = t.idx THEN s.text ELSE '' END AS text FROM tile t JOIN seg s ON s.doc_id = t.doc_id AND s.idx BETWEEN t.idx AND t.idx + t.size - 1 JOIN seg e ON e.doc_id = t.doc_id AND e.idx = t.idx + t.size - 1""")
def window_absorb(spark, d):
    s, tiles = _tiles(spark, d)
    t = tiles.select(F.col("doc_id").alias("_d"), F.col("idx").alias("_at"), F.explode(F.sequence(F.col("idx"), F.col("idx") + F.col("size") - 1)).alias("_i"))
    both = s.join(t, (F.col("doc_id") == F.col("_d")) & (F.col("idx") == F.col("_i")))
    w = Window.partitionBy("doc_id", "_at")
    head = F.col("idx") == F.col("_at")
    return both.select("doc_id", "idx", (~head).alias("absorbed"), F.when(head, F.max("end_c").over(w)).otherwise(F.col("end_c")).alias("end_c"), F.when(head, F.col("text")).otherwise("").alias("text"))


# every event lasts 30 longer than its segment, so that neighbours overlap
@query("WITH RECURSIVE " + SEG + """, r AS (
  SELECT doc_id, idx, start_c AS s, greatest(end_c + 30, start_c + 4) AS e FROM seg WHERE idx = 0
  UNION ALL
  SELECT g.doc_id, g.idx, CASE WHEN r.e > 0 THEN greatest(g.start_c, r.e + 2) ELSE g.start_c END, greatest(g.end_c + 30, CASE WHEN r.e > 0 THEN greatest(g.start_c, r.e + 2) ELSE g.start_c END + 4)
  FROM r JOIN seg g ON g.doc_id = r.doc_id AND g.idx = r.idx + 1)
SELECT doc_id, idx, s AS start_c, e AS end_c FROM r""")
def event_deoverlap(spark, d):
    return folds.separate(_seg(spark, d).withColumn("end_c", F.col("end_c") + 30), ["doc_id"], 2, 4)


@query("WITH " + CLIP + """, len AS (SELECT doc_id, max(end_c) AS length FROM seg GROUP BY doc_id),
ins AS (SELECT l.doc_id, l.length, CASE WHEN c.start_c IS NOT NULL THEN greatest(c.start_c, 45) END AS s, least(c.end_c, l.length - 45) AS e FROM len l LEFT JOIN clip c ON c.doc_id = l.doc_id),
k AS (SELECT * FROM ins WHERE s IS NOT NULL AND e - s >= 8),
g AS (SELECT doc_id, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, s AS hi FROM k
      UNION ALL SELECT l.doc_id, coalesce((SELECT max(e) FROM k WHERE k.doc_id = l.doc_id), 0), l.length FROM len l)
SELECT doc_id, 'insert' AS kind, s AS start_c, e AS end_c FROM k UNION ALL SELECT doc_id, 'original', lo, hi FROM g WHERE hi - lo >= 3""")
def gap_fill_timeline(spark, d):
    n = _seg(spark, d).groupBy("doc_id").agg(F.max("end_c").alias("length"))
    c = _clips(spark, d).select(F.col("doc_id").alias("_d"), "start_c", "end_c")
    return folds.fill_gaps(n.join(c, F.col("doc_id") == F.col("_d"), "left").drop("_d"), ["doc_id"], "length", 45, 8, 3)


# hundredths of a second from characters, 15 to a second; lengths and guards of the balanced mode
@query("WITH " + CLIP + """, b AS (SELECT doc_id, place, (end_c - start_c) * 100 // 15 AS d FROM clip), f AS (
  SELECT doc_id, place, d, CASE WHEN d < 2200 THEN [50] WHEN d < 3800 THEN [36, 70] ELSE [24, 52, 78] END AS c, CASE WHEN d < 3800 THEN 190 ELSE 170 END AS len, greatest(190, d - 200 - CASE WHEN d < 3800 THEN 190 ELSE 170 END) AS late FROM b),
x1 AS (SELECT *, least(greatest(125 + 70, greatest(190, d * c[1] // 100 - len // 2)), late) AS s1 FROM f), y1 AS (SELECT *, least(d - 200, s1 + len) AS e1 FROM x1), z1 AS (SELECT *, e1 - s1 >= 110 AS ok1 FROM y1), l1 AS (SELECT *, CASE WHEN ok1 THEN e1 ELSE 125 END AS last1 FROM z1),
x2 AS (SELECT *, CASE WHEN len(c) >= 2 THEN least(greatest(last1 + 70, greatest(190, d * c[2] // 100 - len // 2)), late) END AS s2 FROM l1), y2 AS (SELECT *, least(d - 200, s2 + len) AS e2 FROM x2), z2 AS (SELECT *, coalesce(len(c) >= 2 AND e2 - s2 >= 110, false) AS ok2 FROM y2), l2 AS (SELECT *, CASE WHEN ok2 THEN e2 ELSE last1 END AS last2 FROM z2),
x3 AS (SELECT *, CASE WHEN len(c) >= 3 THEN least(greatest(last2 + 70, greatest(190, d * c[3] // 100 - len // 2)), late) END AS s3 FROM l2), y3 AS (SELECT *, least(d - 200, s3 + len) AS e3 FROM x3), z3 AS (SELECT *, coalesce(len(c) >= 3 AND e3 - s3 >= 110, false) AS ok3 FROM y3),
ai AS (SELECT doc_id, place, d, 1 AS slot, s1 AS s, e1 AS e FROM z3 WHERE ok1 UNION ALL SELECT doc_id, place, d, 2, s2, e2 FROM z3 WHERE ok2 UNION ALL SELECT doc_id, place, d, 3, s3, e3 FROM z3 WHERE ok3),
gp AS (SELECT doc_id, place, 0 AS slot, coalesce(lag(e) OVER w, 0) AS s, s AS e, 'original_segment' AS notes FROM ai WINDOW w AS (PARTITION BY doc_id, place ORDER BY slot)
  UNION ALL SELECT doc_id, place, 0, max(e), max(d), 'original_outro' FROM ai GROUP BY doc_id, place),
al AS (SELECT doc_id, place, slot, s, e, 'insert' AS notes FROM ai UNION ALL SELECT * FROM gp WHERE e - s >= 30 UNION ALL SELECT doc_id, place, 0, 0, d, 'fallback_original_only' FROM b WHERE (doc_id, place) NOT IN (SELECT doc_id, place FROM ai))
SELECT doc_id, place, CASE WHEN slot > 0 THEN 'stock_video' ELSE 'original' END AS kind, CAST(slot AS BIGINT) AS slot, CAST(s AS BIGINT) AS beat_start, CAST(e AS BIGINT) AS beat_end, notes FROM al WHERE e - s > 20""")
def beat_schedule(spark, d):
    c = _clips(spark, d).select("doc_id", "place", F.floor((F.col("end_c") - F.col("start_c")) * 100 / 15).cast("long").alias("d"))
    return folds.schedule_beats(c, ["doc_id", "place"], "d").drop("d")


@query("WITH " + CLIP + """, b AS (SELECT doc_id, place, end_c - start_c AS d, least(45, greatest(18, end_c - start_c - 18)) AS i FROM clip)
SELECT doc_id, place, 'original' AS kind, 0 AS beat_start, CASE WHEN d - i < 18 THEN d ELSE i END AS beat_end FROM b UNION ALL SELECT doc_id, place, 'stock_video', i, d FROM b WHERE d - i >= 18""")
def two_beat_plan(spark, d):
    return clips.two_beats(_clips(spark, d).select("doc_id", "place", (F.col("end_c") - F.col("start_c")).alias("d")), "d").drop("d")


@query("WITH " + SEG + """, m AS (SELECT doc_id, idx, (end_c - start_c) * 66 AS ms FROM seg), t AS (
  SELECT *, CASE WHEN idx > 0 THEN greatest(50, least(500, lag(ms) OVER w // 2, ms // 2)) END AS f FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY idx)), o AS (
  SELECT doc_id, idx, f, coalesce(sum(ms) OVER p, 0) - coalesce(sum(f) OVER p, 0) - f AS off FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, idx, CAST(f AS BIGINT) AS fade_ms, CAST(greatest(0, off) AS BIGINT) AS offset_ms FROM o WHERE f IS NOT NULL""")
def crossfade_offsets(spark, d):
    return clips.crossfades(_seg(spark, d).select("doc_id", "idx", ((F.col("end_c") - F.col("start_c")) * 66).alias("ms")), "doc_id", 500)


WORDS = SEG + r""", w AS (SELECT doc_id, idx, start_c, end_c, list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x85\p{Z}]+'), lambda x: x <> '') AS l FROM seg), e AS (
  SELECT doc_id, idx, start_c, end_c, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS pos FROM w), c AS (
  SELECT *, sum(length(word)) OVER (PARTITION BY doc_id, idx ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum, sum(length(word)) OVER (PARTITION BY doc_id, idx) AS al FROM e), wt AS (
  SELECT doc_id, idx, CAST(pos AS BIGINT) AS pos, word, CAST(start_c + floor((end_c - start_c) * (cum - length(word)) / al) AS BIGINT) AS word_start, CAST(start_c + floor((end_c - start_c) * cum / al) AS BIGINT) AS word_end FROM c)"""


@query("WITH " + WORDS + " SELECT * FROM wt")
def word_time_allocation(spark, d):
    return clips.word_times(_seg(spark, d))


@query("WITH " + CLIP + "," + WORDS[len(SEG) + 2 :] + """ SELECT k.doc_id, k.place, t.word, greatest(t.word_start, k.start_c) - k.start_c AS word_start, least(t.word_end, k.end_c) - k.start_c AS word_end
FROM clip k JOIN wt t ON t.doc_id = k.doc_id AND t.word_end > k.start_c AND t.word_start < k.end_c WHERE least(t.word_end, k.end_c) - greatest(t.word_start, k.start_c) > 0""")
def clip_words(spark, d):
    w = clips.word_times(_seg(spark, d)).withColumnsRenamed({"word_start": "start_c", "word_end": "end_c"})
    return intervals.clamp_words(_clips(spark, d), w).select("doc_id", "place", "word", "word_start", "word_end")


# --- scores ------------------------------------------------------------------------------

_IN = lambda items: "(" + ", ".join(f"'{x}'" for x in items) + ")"
_WS = r"'[\s\x0b\x1c-\x1f\x85\p{Z}]+'"
_SPLIT = lambda c: f"list_filter(regexp_split_to_array({c}, {_WS}), lambda x: x <> '')"
_EDGES = "،؛:.?!؟"
BORDERS = f""", nb AS (
  SELECT doc_id, idx, text, start_c, end_c, {_SPLIT("text")} AS w, coalesce(lag(text) OVER o, '') AS before, coalesce(lead(text) OVER o, '') AS after FROM seg WINDOW o AS (PARTITION BY doc_id ORDER BY idx)
), feat AS (
  SELECT *, regexp_matches(trim(text, ' '), '[.؟!?۔…:؛]$') AS stop, trim(after, ' ') <> '' AND NOT regexp_matches(trim(text, ' '), '[.؟!?۔…:؛]$') AS open_after,
    trim(before, ' ') <> '' AND NOT regexp_matches(trim(before, ' '), '[.؟!?۔…:؛]$') AS open_before,
    coalesce(len(w) = 0 OR w[1] IN {_IN(LATIN.starts)} OR array_to_string(w[1:2], ' ') IN {_IN(LATIN.starts)}, false) AS starts,
    coalesce(len(w) = 0 OR w[-1] IN {_IN(LATIN.ends)} OR array_to_string(w[greatest(len(w) - 1, 1):], ' ') IN {_IN(LATIN.ends)}, false) AS ends,
    len(list_filter(list_transform(w, lambda x: trim(x, '{_EDGES}')), lambda x: x IN {_IN(LATIN.payoff)})) > 0 AS payoff,
    list_transform(w[1:6], lambda x: trim(x, '{_EDGES}')) AS f6, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY idx) AS cumw FROM nb
), sc AS (
  SELECT *, CASE WHEN len(f6) = 0 THEN 3200 ELSE least(2600, CASE WHEN f6[1] IN {_IN(LATIN.context)} THEN 1400 ELSE 0 END + least(1200, 350 * len(list_filter(f6, lambda x: x IN {_IN(LATIN.context)})))) END AS ctx FROM feat
), part AS (
  SELECT *, greatest(0, least(10000, 7400 - ctx - (CASE WHEN starts THEN 3200 ELSE 0 END) - (CASE WHEN open_before THEN 800 ELSE 0 END) - (CASE WHEN len(w) < 5 THEN 400 ELSE 0 END) - (CASE WHEN ends_with(trim(text, ' '), ':') THEN 600 ELSE 0 END))) AS beginning,
    greatest(0, least(10000, 7000 + (CASE WHEN stop THEN 1800 ELSE 0 END) + (CASE WHEN payoff THEN 1600 ELSE 0 END) - (CASE WHEN ends THEN 2800 ELSE 0 END) - (CASE WHEN open_after THEN 800 ELSE 0 END))) AS ending,
    least(10000, 800 + ctx + (CASE WHEN starts THEN 2200 ELSE 0 END) + (CASE WHEN open_before THEN 800 ELSE 0 END)) AS prior,
    least(10000, 600 + (CASE WHEN ends THEN 2800 ELSE 0 END) + (CASE WHEN open_after THEN 1400 ELSE 0 END) + (CASE WHEN NOT payoff AND NOT stop THEN 600 ELSE 0 END)) AS following,
    greatest(0, least(10000, 4800 + (CASE WHEN stop THEN 1600 ELSE 0 END) + (CASE WHEN payoff THEN 2200 ELSE 0 END) - (CASE WHEN ends THEN 2200 ELSE 0 END))) AS resolution FROM sc)"""
_SUB = lambda win: f""", ss AS (  -- win: doc_id, s, e and more
  SELECT v.*, b.beginning, l.ending, b.prior, l.following, l.resolution, l.end_c - b.start_c AS length, l.cumw - b.cumw + len(b.w) AS nw FROM {win} v JOIN part b ON b.doc_id = v.doc_id AND b.idx = v.s JOIN part l ON l.doc_id = v.doc_id AND l.idx = v.e
), st AS (
  SELECT *, greatest(0, least(10000, 2400 + (25 * beginning + 25 * ending + 14 * (10000 - prior) + 12 * (10000 - following)) // 100 - CASE WHEN nw < 16 THEN 800 ELSE 0 END)) AS standalone FROM ss
), sv AS (
  SELECT *, (30 * beginning + 30 * ending + 25 * standalone + 15 * resolution) // 100 AS overall,
    CAST(floor((10 * 5000 + 23 * beginning + 23 * ending + 18 * standalone + 10 * (10000 - prior) + 8 * (10000 - following) + 5 * resolution + 3 * greatest(0, 10000 - CAST(floor(10000 * abs(length - 630) / 240) AS BIGINT))) / 100) AS BIGINT)
      - (CASE WHEN beginning < 5200 THEN 1200 ELSE 0 END + CASE WHEN ending < 5400 THEN 1400 ELSE 0 END + CASE WHEN standalone < 5200 THEN 1200 ELSE 0 END + CASE WHEN prior > 4800 THEN 1200 ELSE 0 END + CASE WHEN following > 4800 THEN 1400 ELSE 0 END + CASE WHEN resolution < 4600 THEN 600 ELSE 0 END) AS editorial FROM st)"""  # noqa: E731
_BIG = lambda *cols: ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols)


@query("WITH " + CLIP + BORDERS + ", v AS (SELECT doc_id, place, start_idx AS s, end_idx AS e FROM clip)" + _SUB("v") + " SELECT doc_id, place, " + _BIG("beginning", "ending", "prior", "following", "resolution", "standalone", "overall") + " FROM sv")
def clip_subscores(spark, d):
    c = _clips(spark, d).select("doc_id", "place", F.col("start_idx").alias("s"), F.col("end_idx").alias("e"))
    return clips.with_sub_scores(c, _seg(spark, d)).select("doc_id", "place", "beginning", "ending", "prior", "following", "resolution", "standalone", "overall")


@query("WITH " + CLIP + BORDERS + """, li AS (SELECT doc_id, max(idx) AS last_idx FROM seg GROUP BY doc_id), gr AS (
  SELECT DISTINCT c.doc_id, c.start_idx, c.end_idx, greatest(0, least(last_idx, c.start_idx + ds)) AS s, greatest(0, least(last_idx, c.end_idx + de)) AS e
  FROM clip c JOIN li ON li.doc_id = c.doc_id, (SELECT unnest(range(-4, 3)) AS ds), (SELECT unnest(range(-2, 5)) AS de)), v AS (SELECT * FROM gr WHERE e >= s)""" + _SUB("v") + """
SELECT doc_id, start_idx, end_idx, CAST(s AS BIGINT) AS best_s, CAST(e AS BIGINT) AS best_e, CAST(editorial AS BIGINT) AS best_editorial,
  length <= 885 AND beginning >= 5000 AND ending >= 5200 AND standalone >= 5000 AND prior <= 5400 AND following <= 5400 AND overall >= 5200 AS passed
FROM sv WHERE length BETWEEN 300 AND 885 QUALIFY row_number() OVER (PARTITION BY doc_id, start_idx, end_idx ORDER BY editorial DESC, ending DESC, beginning DESC, s, e) = 1""")
def clip_boundary_repair(spark, d):
    return clips.repair_borders(_clips(spark, d).select("doc_id", "start_idx", "end_idx"), _seg(spark, d)).select("doc_id", "start_idx", "end_idx", "best_s", "best_e", "best_editorial", "passed")


# the finder end to end; constants are the reference rules' in ten-thousandths and characters
_KEPT = lambda src, percent, guard: f"list_reduce(list_transform({src}, lambda x: [x]), lambda a, x: CASE WHEN {guard} len(list_filter(a, lambda y: least(x[1].z - x[1].a, y.z - y.a) > 0 AND 100 * (least(x[1].z, y.z) - greatest(x[1].a, y.a)) >= {percent} * least(x[1].z - x[1].a, y.z - y.a))) > 0 THEN a ELSE list_concat(a, x) END)"
FOUND = WIN[: WIN.index(", scored AS (")] + BORDERS + ", v AS (SELECT p.doc_id, p.start_idx AS s, p.end_idx AS e FROM pairs p JOIN part b ON b.doc_id = p.doc_id AND b.idx = p.start_idx WHERE NOT b.starts)" + _SUB("v") + f""", ho AS (
  SELECT doc_id, list({{'s': s, 'e': e, 'a': a, 'z': z, 'ed': CAST(editorial AS BIGINT)}} ORDER BY editorial DESC, length DESC, s, e) AS l FROM (SELECT sv.*, x.start_c AS a, x.start_c + sv.length AS z FROM sv JOIN seg x ON x.doc_id = sv.doc_id AND x.idx = sv.s) WHERE editorial >= 0 GROUP BY doc_id
), hk AS (SELECT doc_id, {_KEPT("l", 70, "len(a) >= 48 OR")} AS k FROM ho), hc AS (SELECT doc_id, CAST(p - 1 AS BIGINT) AS place, k[p].s AS s, k[p].e AS e, k[p].a AS a, k[p].z AS z, k[p].ed AS ed FROM (SELECT doc_id, k, unnest(range(1, len(k) + 1)) AS p FROM hk))"""


@query("WITH " + FOUND + " SELECT doc_id, place, s AS start_idx, e AS end_idx, a AS start_c, z AS end_c, ed AS editorial FROM hc")
def heuristic_clips(spark, d):
    return clips.heuristic_clips(_seg(spark, d), 3)


_AGAIN = _SUB("rv").replace("ss AS", "ss2 AS").replace("st AS", "st2 AS").replace("sv AS", "sv2 AS").replace("FROM ss", "FROM ss2").replace("FROM st", "FROM st2").replace("10 * 5000", "10 * confidence")


@query("WITH " + FOUND + """, li AS (SELECT doc_id, max(idx) AS last_idx FROM seg GROUP BY doc_id), rv AS (
  SELECT DISTINCT * FROM (SELECT c.doc_id, c.place, least(10000, greatest(0, (c.ed + 5) // 10 * 10)) AS confidence, greatest(0, least(last_idx, c.s + ds)) AS s, greatest(0, least(last_idx, c.e + de)) AS e
  FROM hc c JOIN li ON li.doc_id = c.doc_id, (SELECT unnest(range(-4, 3)) AS ds), (SELECT unnest(range(-2, 5)) AS de)) WHERE e >= s)""" + _AGAIN + f""", rb AS (
  SELECT * FROM sv2 WHERE length BETWEEN 300 AND 885 QUALIFY row_number() OVER (PARTITION BY doc_id, place ORDER BY editorial DESC, ending DESC, beginning DESC, s, e) = 1
), ok AS (SELECT r.*, x.start_c AS a, x.start_c + r.length AS z, CAST(least(10000, greatest(0, r.editorial)) AS BIGINT) AS ed FROM rb r JOIN seg x ON x.doc_id = r.doc_id AND x.idx = r.s
  WHERE length <= 885 AND beginning >= 5000 AND ending >= 5200 AND standalone >= 5000 AND prior <= 5400 AND following <= 5400 AND overall >= 5200
), fo AS (SELECT doc_id, list({{'s': CAST(s AS BIGINT), 'e': CAST(e AS BIGINT), 'a': a, 'z': z, 'ed': ed}} ORDER BY ed DESC, ending DESC, beginning DESC, standalone DESC, length, a, place) AS l FROM ok GROUP BY doc_id
), fk AS (SELECT doc_id, unnest({_KEPT("l", 68, "")}) AS r FROM fo)
SELECT doc_id, row_number() OVER w - 1 AS place, r.s AS start_idx, r.e AS end_idx, r.a AS start_c, r.z AS end_c, r.ed AS editorial FROM fk WINDOW w AS (PARTITION BY doc_id ORDER BY r.ed DESC, r.a, r.s, r.e) QUALIFY row_number() OVER w <= 3""")
def finished_clips(spark, d):
    return clips.finished_clips(_seg(spark, d), 3)


@query("WITH " + CLIP + BORDERS + """, li AS (SELECT doc_id, max(idx) AS last_idx FROM seg GROUP BY doc_id), gr AS (
  SELECT c.doc_id, c.place, c.start_idx AS s0, c.end_idx AS e0, greatest(0, least(last_idx, c.start_idx + ds)) AS s, greatest(0, least(last_idx, c.end_idx + de)) AS e
  FROM clip c JOIN li ON li.doc_id = c.doc_id, (SELECT unnest(range(-1, 2)) AS ds), (SELECT unnest(range(-1, 3)) AS de)), v AS (SELECT DISTINCT * FROM gr WHERE e >= s), lw AS (
  SELECT v.*, 7000 - CASE WHEN b.starts THEN 3600 ELSE 0 END + CASE WHEN len(b.w) <= 8 THEN 600 ELSE 0 END AS o,
    6200 + CASE WHEN l.stop THEN 2000 ELSE 0 END + CASE WHEN l.payoff THEN 800 ELSE 0 END - CASE WHEN l.ends THEN 3000 ELSE 0 END - CASE WHEN trim(l.after, ' ') <> '' AND coalesce(x.starts, false) THEN 1000 ELSE 0 END AS n,
    6600 - CASE WHEN b.starts THEN 2200 ELSE 0 END - CASE WHEN l.ends THEN 1800 ELSE 0 END AS a, l.end_c - b.start_c AS d, v.s - v.s0 AS ds, v.e - v.e0 AS de
  FROM v JOIN part b ON b.doc_id = v.doc_id AND b.idx = v.s JOIN part l ON l.doc_id = v.doc_id AND l.idx = v.e LEFT JOIN part x ON x.doc_id = v.doc_id AND x.idx = v.e + 1), p AS (
  SELECT *, CASE WHEN d <= 0 THEN -1 ELSE CAST(floor((30 * o + 34 * n + 22 * a + 14 * greatest(0, 10000 - CAST(floor(10000 * abs(d - 420) / 150) AS BIGINT))) / 100) AS BIGINT) END AS points FROM lw)
SELECT doc_id, place, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, CAST(points AS BIGINT) AS points,
  CASE WHEN ds = 0 AND de = 0 AND n < 7800 AND o < 7200 THEN 'kept_original_boundaries' ELSE concat_ws('; ', CASE WHEN ds <> 0 THEN 'start_adjusted_to_segment_boundary' END, CASE WHEN de <> 0 THEN 'end_adjusted_to_complete_thought' END,
    CASE WHEN n >= 7800 THEN 'ending_scores_strong' END, CASE WHEN o >= 7200 THEN 'opening_scores_clean' END) END AS reason
FROM p WHERE points >= 0 QUALIFY row_number() OVER (PARTITION BY doc_id, place ORDER BY points DESC, n DESC, o DESC, abs(d - 420), s, e) = 1""")
def refine_window(spark, d):
    return clips.refined_windows(_clips(spark, d).select("doc_id", "place", "start_idx", "end_idx"), _seg(spark, d))


@query("""SELECT page_id, CAST(greatest(0, 100 - CASE WHEN t < 720 THEN 25 WHEN t < 1080 THEN 10 ELSE 0 END - CASE WHEN v AND h <= w THEN 10 ELSE 0 END
  - CASE WHEN v AND ms <= 0 THEN 20 WHEN v AND ms < 1200 THEN 15 WHEN v AND ms > 12000 THEN 5 ELSE 0 END - CASE WHEN v AND fps > 0 AND fps < 20 THEN 15 ELSE 0 END - CASE WHEN sz < 120000 THEN 10 ELSE 0 END) AS BIGINT) AS score,
  concat_ws(',', CASE WHEN t < 720 THEN 'resolution_below_720' END, CASE WHEN t >= 720 AND t < 1080 THEN 'resolution_below_1080' END, CASE WHEN v AND h <= w THEN 'not_portrait' END, CASE WHEN v AND ms <= 0 THEN 'duration_missing' END,
  CASE WHEN v AND ms > 0 AND ms < 1200 THEN 'very_short_video' END, CASE WHEN v AND ms > 12000 THEN 'long_for_insert' END, CASE WHEN v AND fps > 0 AND fps < 20 THEN 'low_frame_rate' END, CASE WHEN sz < 120000 THEN 'small_file_size' END) AS flags
FROM (SELECT page_id, page_id % 3 > 0 AS v, 480 + page_id % 900 AS w, 500 + page_id * 7 % 1500 AS h, greatest(480 + page_id % 900, 500 + page_id * 7 % 1500) AS t, page_id * 131 % 14000 - 200 AS ms, page_id % 40 AS fps, length(html) * 60 AS sz FROM pages)""")
def asset_rules(spark, d):
    p = table(spark, d, "pages").select("page_id", (F.col("page_id") % 3 > 0).alias("v"), (480 + F.col("page_id") % 900).alias("w"), (500 + F.col("page_id") * 7 % 1500).alias("h"), (F.col("page_id") * 131 % 14000 - 200).alias("ms"), (F.col("page_id") % 40).alias("fps"), (F.length("html") * 60).alias("sz"))
    score, flags = scoring.asset_rules(*[F.col(c) for c in ("v", "w", "h", "ms", "fps", "sz")])
    return p.select("page_id", score.alias("score"), flags.alias("flags"))


_PT = lambda c: rf"list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(lower({c}), '[،,:;؛.!?؟]', ' ', 'g'), '[^\p{{L}}\p{{N}}_\x{{0600}}-\x{{06FF}}\s-]', ' ', 'g'), '\s+'), lambda x: trim(x, '-_')), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'amp')))"


@query(rf"""WITH q AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN t WHEN 1 THEN t || ' Desert at dusk' WHEN 2 THEN t || ', no people, No Animals' ELSE t || ' ' || html END AS prompt FROM (SELECT *, regexp_extract(html, '<title>([^<]*)', 1) AS t FROM pages)),
m AS (SELECT page_id, prompt, list_sort(list_intersect({_PT("prompt")}, {_PT("url")})) AS c FROM q),
p AS (SELECT page_id, c, greatest(0, least(10000, 3500 + least(3500, 800 * len(c)) + CASE WHEN regexp_matches(lower(prompt), 'dawn|night|rain|ocean|desert|mist|mosque|courtyard|dusk|dark') THEN 1000 ELSE 0 END
  + CASE WHEN contains(lower(prompt), 'no people') AND contains(lower(prompt), 'no animals') THEN 1000 ELSE 0 END - CASE WHEN length(prompt) > 200 THEN 800 ELSE 0 END)) AS s FROM m)
SELECT page_id, CAST(s AS BIGINT) AS points, array_to_string(c[1:12], ',') AS matched, CASE WHEN s >= 7000 THEN 'Good symbolic fit' WHEN s >= 5000 THEN 'Usable but generic' ELSE 'Weak semantic fit' END AS note FROM p""")
def prompt_overlap_score(spark, d):
    t = F.regexp_extract("html", "<title>([^<]*)", 1)
    i = F.col("page_id") % 4
    more = F.when(i == 0, "").when(i == 1, " Desert at dusk").when(i == 2, ", no people, No Animals").otherwise(F.concat(F.lit(" "), F.col("html")))
    got = scoring.prompt_match(F.concat(t, more), F.col("url"), ("the", "and", "amp"))
    return table(spark, d, "pages").select("page_id", got["points"].alias("points"), F.array_join(got["matched"], ",").alias("matched"), got["note"].alias("note"))


_LUMA = "(299 * (page_id * 37 % 256) + 587 * (page_id * 91 % 256) + 114 * (page_id * 13 % 256))"
_COLOUR = lambda c: f"CASE WHEN {c} >= 170000 THEN '&H00202020' WHEN {c} >= 80000 THEN '&H00D5E8F5' ELSE '&H00FFFFFF' END"


def _luma():
    i = F.col("page_id")
    return scoring.luma(i * 37 % 256, i * 91 % 256, i * 13 % 256) / 1000


@query(f"""SELECT page_id, {_COLOUR(_LUMA)} AS colour, array_to_string(CASE WHEN ms <= 0 THEN [0] WHEN ms <= 2000 THEN [0, ms // 2] ELSE list_transform(range(1, 5), lambda k: least(ms - 50, CAST(round(ms * k / 5.0) AS BIGINT))) END, ',') AS frames
FROM (SELECT page_id, page_id * 131 % 14000 - 500 AS ms FROM pages)""")
def brightness_and_frames(spark, d):
    ms = F.col("page_id") * 131 % 14000 - 500
    return table(spark, d, "pages").select("page_id", scoring.text_colour(_luma()).alias("colour"), F.array_join(scoring.sample_times(ms, 4).cast("array<string>"), ",").alias("frames"))


@query(f"SELECT page_id % 400 AS clip, CAST(max({_LUMA}) AS BIGINT) AS luma, {_COLOUR(f'max({_LUMA})')} AS colour FROM pages GROUP BY ALL")
def worst_brightness(spark, d):
    p = table(spark, d, "pages").select((F.col("page_id") % 400).alias("clip"), _luma().alias("luma"))
    return catalog.worst(p, ["clip"], "luma").select("clip", F.round(F.col("luma") * 1000).cast("long").alias("luma"), scoring.text_colour(F.col("luma")).alias("colour"))


@query("""WITH p AS (SELECT page_id, greatest(1000, page_id * 137 % 61000) AS d, CASE page_id % 4 WHEN 0 THEN 'light' WHEN 1 THEN 'cinematic' ELSE 'balanced' END AS mode FROM pages),
q AS (SELECT *, CASE WHEN d < 22000 THEN 1 WHEN d < 38000 THEN 2 ELSE 3 END AS m FROM p), r AS (
SELECT *, CASE WHEN mode = 'light' THEN greatest(1, m - 1) ELSE m END AS n, CASE mode WHEN 'light' THEN 1600 WHEN 'cinematic' THEN CASE WHEN m <= 2 THEN 2200 ELSE 1800 END ELSE CASE WHEN m <= 2 THEN 1900 ELSE 1700 END END AS l FROM q)
SELECT page_id, mode, CAST(n AS BIGINT) AS inserts, CAST(l AS BIGINT) AS insert_ms, CAST(CASE mode WHEN 'light' THEN 2100 WHEN 'cinematic' THEN 1700 ELSE 1900 END AS BIGINT) AS intro_ms,
  CAST(CASE mode WHEN 'light' THEN 2100 WHEN 'cinematic' THEN 1800 ELSE 2000 END AS BIGINT) AS outro_ms, CAST(least(d * 42 // 100, n * l) AS BIGINT) AS scenic_ms, CAST(10000 * least(d * 42 // 100, n * l) // d AS BIGINT) AS ratio4 FROM r""")
def insert_ratio(spark, d):
    i = F.col("page_id")
    mode = F.when(i % 4 == 0, "Light ").when(i % 4 == 1, "cinematic").when(i % 4 == 2, "balanced").otherwise("unheard of")
    return table(spark, d, "pages").select("page_id", scoring.insert_ratio(i * 137 % 61000, mode).alias("r")).select("page_id", "r.*")


# --- retrieval ---------------------------------------------------------------------------

_FOLD = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' ')"
TOK = rf"""bt AS (SELECT item_id, unnest(list_filter(string_split({_FOLD}, ' '), lambda x: x <> '')) AS token, generate_subscripts(list_filter(string_split({_FOLD}, ' '), lambda x: x <> ''), 1) - 1 AS pos FROM benchmark),
dt AS (SELECT doc_id, unnest(list_filter(string_split({_FOLD}, ' '), lambda x: x <> '')) AS token, generate_subscripts(list_filter(string_split({_FOLD}, ' '), lambda x: x <> ''), 1) - 1 AS pos FROM documents),
nb AS (SELECT count(*) AS n FROM benchmark),
idf AS (SELECT token, df, round(1.0 + ln((n + 1.0) / (df + 1)), 4) AS idf FROM (SELECT token, count(DISTINCT item_id) AS df FROM bt WHERE length(token) >= 2 GROUP BY token), nb),
ra AS (SELECT doc_id, token, CAST(round(idf * 10000) AS BIGINT) AS p FROM (SELECT DISTINCT doc_id, token FROM dt) JOIN idf USING (token) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(round(idf * 10000) AS BIGINT) DESC, token) <= 10),
cd AS (SELECT doc_id, item_id, CAST(sum(p) AS BIGINT) AS points FROM ra JOIN (SELECT DISTINCT item_id, token FROM bt) USING (token) GROUP BY ALL),
cand AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, item_id) AS place FROM cd QUALIFY place <= 5)"""


def _retrieval(spark, d):
    bench, docs = table(spark, d, "benchmark"), readers.dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id", 1000)
    bt, dt = retrieval.tokens(bench, "item_id", X.fold_latin(F.col("text"))), retrieval.tokens(docs, "doc_id", X.fold_latin(F.col("text")))
    idf = retrieval.with_idf(retrieval.document_frequency(bt, "item_id"), bench.count())
    return bt, dt, idf, retrieval.candidates(dt, bt, idf, "doc_id", "item_id", 5)


@query("WITH " + TOK + " SELECT token, df, CAST(round(idf * 10000) AS BIGINT) AS idf4 FROM idf")
def token_df_idf(spark, d):
    return _retrieval(spark, d)[2].select("token", "df", F.round(F.col("idf") * 10000).cast("long").alias("idf4"))


@query("WITH " + TOK + " SELECT token, count(DISTINCT item_id) AS n_items, count(*) AS n_places, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items FROM bt GROUP BY token")
def postings_lookup(spark, d):
    bt = _retrieval(spark, d)[0]
    return bt.groupBy("token").agg(F.countDistinct("item_id").alias("n_items"), F.count("*").alias("n_places"), F.array_join(F.sort_array(F.collect_set("item_id")).cast("array<string>"), ",").alias("items"))


@query("WITH " + TOK + " SELECT doc_id, item_id, points, place FROM cand")
def candidate_top_k(spark, d):
    return _retrieval(spark, d)[3]


BAG = TOK + """, common AS (SELECT doc_id, item_id, coalesce(sum(CASE WHEN cb IS NULL THEN 0 ELSE least(ca, cb) END), 0) AS common FROM cand LEFT JOIN (SELECT doc_id, token, count(*) AS ca FROM dt GROUP BY ALL) a USING (doc_id) LEFT JOIN (SELECT item_id, token, count(*) AS cb FROM bt GROUP BY ALL) b USING (item_id, token) GROUP BY ALL),
size AS (SELECT c.*, (SELECT count(*) FROM dt WHERE dt.doc_id = c.doc_id) AS na, (SELECT count(*) FROM bt WHERE bt.item_id = c.item_id) AS nb FROM common c)"""


def _bags(spark, d):
    bt, dt, idf, cand = _retrieval(spark, d)
    pairs = retrieval.bag_overlap(cand.select("doc_id", "item_id"), dt, bt, "doc_id", "item_id")
    pairs = pairs.join(dt.groupBy("doc_id").agg(F.count("*").alias("na")), "doc_id").join(bt.groupBy("item_id").agg(F.count("*").alias("nb")), "item_id")
    return bt, dt, idf, pairs


@query("WITH " + BAG + " SELECT doc_id, item_id, CAST(common AS BIGINT) AS common, CAST(floor(20000 * common / (na + nb)) AS BIGINT) AS f1_4 FROM size")
def bag_f1(spark, d):
    p = _bags(spark, d)[3]
    return p.select("doc_id", "item_id", "common", F.floor(20000 * F.col("common") / (F.col("na") + F.col("nb"))).cast("long").alias("f1_4"))


WO = BAG + """, wt AS (SELECT item_id, token, CAST(round(coalesce(idf, 1.0) * 10000) AS BIGINT) AS w FROM (SELECT DISTINCT item_id, token FROM bt) LEFT JOIN idf USING (token)),
wo AS (SELECT s.*, (SELECT sum(w) FROM wt WHERE wt.item_id = s.item_id) AS all4, coalesce((SELECT sum(w) FROM wt WHERE wt.item_id = s.item_id AND wt.token IN (SELECT token FROM dt WHERE dt.doc_id = s.doc_id)), 0) AS matched4 FROM size s)"""


def _weighted(spark, d):
    bt, dt, idf, pairs = _bags(spark, d)
    return bt, dt, idf, retrieval.weighted_coverage(pairs, bt, dt, idf, "item_id", "doc_id")


@query("WITH " + WO + " SELECT doc_id, item_id, CAST(matched4 AS BIGINT) AS matched4, CAST(all4 AS BIGINT) AS all4 FROM wo")
def weighted_overlap(spark, d):
    return _weighted(spark, d)[3].select("doc_id", "item_id", "matched4", "all4")


BG = WO + """, bl AS (SELECT item_id, list(token ORDER BY pos) AS l FROM bt GROUP BY ALL), dl AS (SELECT doc_id, list(token ORDER BY pos) AS l FROM dt GROUP BY ALL),
bb AS (SELECT item_id, list_distinct(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS g FROM bl), db AS (SELECT doc_id, list_distinct(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS g FROM dl),
bo AS (SELECT w.*, CASE WHEN len(bb.g) > 0 THEN 1000 * len(list_intersect(bb.g, db.g)) // len(bb.g) ELSE 0 END AS bo3 FROM wo w JOIN bb USING (item_id) JOIN db USING (doc_id))"""


def _bigrams(spark, d):
    bt, dt, idf, pairs = _weighted(spark, d)
    bench, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    gb = bench.select("item_id", X.ngrams(X.words(X.fold_latin(F.col("text")))).alias("gb"))
    gd = docs.select("doc_id", X.ngrams(X.words(X.fold_latin(F.col("text")))).alias("gd"))
    return pairs.join(gb, "item_id").join(gd, "doc_id").withColumn("bo3", retrieval.bigram_coverage(F.col("gb"), F.col("gd"))).drop("gb", "gd")


@query("WITH " + BG + " SELECT doc_id, item_id, CAST(bo3 AS BIGINT) AS bo3 FROM bo")
def bigram_overlap(spark, d):
    return _bigrams(spark, d).select("doc_id", "item_id", "bo3")


@query("WITH " + TOK + """, an AS (SELECT token FROM idf, nb WHERE df <= 0.08 * n), h AS (SELECT DISTINCT item_id, doc_id, token, cp - sp + k AS start FROM (SELECT b.item_id, a.doc_id, token, a.pos AS cp, b.pos AS sp FROM bt b JOIN dt a USING (token) WHERE token IN (SELECT token FROM an)), (SELECT unnest([-1, 0, 1]) AS k) WHERE cp - sp + k >= 0)
SELECT item_id, doc_id, start, count(*) AS hits FROM h GROUP BY ALL HAVING count(*) >= 3""")
def fragment_anchor_spans(spark, d):
    bt, dt, idf, _ = _retrieval(spark, d)
    n = table(spark, d, "benchmark").count()
    return retrieval.fragment_starts(bt, dt, idf.filter(F.col("df") <= 0.08 * n), "item_id", "doc_id").filter("hits >= 3").select("item_id", "doc_id", F.col("start").cast("long").alias("start"), "hits")


@query()
def char_ratio(spark, d):
    """Ratcliff-Obershelp similarity of each candidate pair's texts, in all languages."""
    cand = _retrieval(spark, d)[3]
    a = table(spark, d, "documents").select("doc_id", F.col("text").alias("a"))
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("b"))
    return cand.join(a, "doc_id").join(b, "item_id").select("doc_id", "item_id", X.char_ratio("a", "b").alias("ratio"))


def _sides(spark, d):
    """(doc_id, tokens) of all documents, (item_id, tokens) of all items."""
    of = lambda name, key: table(spark, d, name).select(key, X.words(X.fold_latin(F.col("text"))).alias("tokens"))
    return of("documents", "doc_id"), of("benchmark", "item_id")


def _corpus(corpus, key):
    """idf and common tokens of a corpus."""
    n = corpus.count()
    df = retrieval.document_frequency(corpus.select(key, F.explode("tokens").alias("token")), key)
    return retrieval.with_idf(df, n), retrieval.common_tokens(df, n)


_AR = "'قُلْ هُوَ، ٱللَّهُ. أَحَدٌ {x} 1٢' || chr(9) || text"
_MARKS = r"'[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]'"


def _arabic():
    return F.concat(F.lit("قُلْ هُوَ، ٱللَّهُ. أَحَدٌ {x} 1٢\t"), F.col("text"))


# these texts have no compatibility characters: the composed form is the compatibility form
@query(rf"SELECT item_id, trim(regexp_replace(regexp_replace(translate(regexp_replace(replace(nfc_normalize({_AR}), 'ـ', ''), {_MARKS}, '', 'g'), 'أإآٱىؤئة', 'اااايويه'), '[^\x{{0600}}-\x{{06FF}}0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS folded FROM benchmark")
def normalise_arabic(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.fold_arabic(_arabic()).alias("folded"))


@query(rf"""WITH b AS (SELECT item_id, {_AR} AS t FROM benchmark), c AS (SELECT *, regexp_replace(nfc_normalize(t), '[^\x{{0600}}-\x{{06FF}}\x{{0750}}-\x{{077F}}\x{{08A0}}-\x{{08FF}}\x{{FB50}}-\x{{FDFF}}\x{{FE70}}-\x{{FEFF}}\s0-9٠-٩.,!?:;"''،؛؟-]', '', 'g') AS cap FROM b)
SELECT item_id, regexp_replace(t, {_MARKS}, '', 'g') AS bare, trim(regexp_replace(replace(nfc_normalize(t), 'ـ', ''), '\s+', ' ', 'g'), ' ') AS shown, cap,
  array_to_string(list_filter(regexp_split_to_array(regexp_replace(cap, '([،,:;؛.!?؟])', '\1 ', 'g'), '\s+'), lambda x: x <> ''), '|') AS words, regexp_matches(trim(t, ' '), '[.؟!:…]$') AS closed,
  chr(8235) || replace(replace(t, '{{', '\{{'), '}}', '\}}') || chr(8236) || '\N' || chr(8235) || 'x' || chr(8236) AS ass FROM c""")
def caption_texts(spark, d):
    t = _arabic()
    return table(spark, d, "benchmark").select(
        "item_id", X.strip_diacritics(t).alias("bare"), X.render_arabic(t).alias("shown"), X.caption_arabic(t).alias("cap"), F.array_join(X.caption_words(t, clean=True), "|").alias("words"),
        X.ends_with_mark(t).alias("closed"), X.rtl_lines(X.ass_escape(F.concat(t, F.lit("\\Nx")))).alias("ass"),
    )


@query("SELECT page_id, 'src' || page_id || CASE WHEN page_id % 3 > 0 THEN '__clip01' ELSE '' END AS stem, CASE WHEN page_id % 3 = 2 THEN 'warm' ELSE '' END AS preset, CAST(page_id % 7 AS VARCHAR) || ':' || page_id AS verse, row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id % 7, page_id) AS place FROM pages".replace("|| CASE WHEN page_id % 3 > 0 THEN '__clip01' ELSE '' END ", ""))
def file_names_and_keys(spark, d):
    i = F.col("page_id")
    name = F.concat(F.lit("/a.b/src"), i.cast("string"), F.when(i % 3 == 0, ".mp4").when(i % 3 == 1, "__clip01.mp4").otherwise("__clip01__warm.mp4"))
    verse = F.concat((i % 7).cast("string"), F.lit(":"), i.cast("string"))
    stem, preset = X.file_parts(name)
    w = Window.partitionBy(i % 3).orderBy(*X.verse_order(verse))
    return table(spark, d, "pages").select("page_id", stem.alias("stem"), preset.alias("preset"), verse.alias("verse"), F.row_number().over(w).cast("long").alias("place"))


@query(f"WITH w AS (SELECT conv_id, turn, {_SPLIT('text')} AS w FROM conversations) SELECT conv_id, turn, i AS pos, md5(array_to_string(w[1:i + 1], ' ')) AS shown FROM (SELECT *, unnest(range(0, len(w))) AS i FROM w)")
def word_reveal(spark, d):
    w = table(spark, d, "conversations").select("conv_id", "turn", X.words(F.col("text")).alias("w"))
    w = w.select("conv_id", "turn", "w", F.posexplode("w").alias("pos", "_"))
    return w.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.md5(X.revealed(F.col("w"), F.col("pos")).cast("binary")).alias("shown"))


@query("SELECT role, count_if(turn % 3 = 1 AND trim(text, ' ') <> trim(text, ' ') || '!') AS changed FROM conversations GROUP BY role")
def changed_rows(spark, d):
    new = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, F.concat(F.trim("text"), F.lit("!"))).otherwise(F.trim("text"))
    return table(spark, d, "conversations").groupBy("role").agg(catalog.changed_rows(F.col("text"), new).alias("changed"))


@query("SELECT doc_id, " + _FOLD + " AS folded FROM documents")
def normalise_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.fold_latin(F.col("text")).alias("folded"))


# --- scalars -----------------------------------------------------------------------------


@query(r"""SELECT page_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug, t AS title FROM (SELECT page_id, trim(regexp_replace(regexp_replace(lower(trim(regexp_extract(html, '<title>([^<]*)', 1), ' ')), '[^\p{L}\p{N} _.-]', '', 'g'), '[ _.-]+', '-', 'g'), '-') AS s,
  trim(regexp_replace(regexp_replace(regexp_extract(url, '([^/?#]*)/?(?:[?#].*)?$', 1), '\.[a-z]+$', ''), '[-_]+', ' ', 'g'), ' ') AS t FROM pages)""")
def slugs_and_titles(spark, d):
    return table(spark, d, "pages").select("page_id", X.slug(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("slug"), X.url_title(F.col("url")).alias("title"))


@query("WITH " + SEG + """, m AS (SELECT doc_id, idx, start_c * 1000 // 15 AS t FROM seg)
SELECT doc_id, idx, lpad(CAST(t // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(t % 1000 AS VARCHAR), 3, '0') AS srt, t AS back,
 CAST((t // 10) // 360000 AS VARCHAR) || ':' || lpad(CAST((t // 10) // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((t // 10) // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST((t // 10) % 100 AS VARCHAR), 2, '0') AS ass FROM m""")
def subtitle_times(spark, d):
    s = _seg(spark, d).select("doc_id", "idx", F.floor(F.col("start_c") * 1000 / 15).cast("long").alias("t"))
    s = s.withColumn("srt", X.srt_time(F.col("t")))
    return s.select("doc_id", "idx", "srt", X.srt_ms(F.col("srt")).alias("back"), X.ass_time(F.floor(F.col("t") / 10).cast("long")).alias("ass"))


@query("WITH " + SEG + """, m AS (SELECT doc_id, idx, text, start_c * 1000 // 15 AS a, end_c * 1000 // 15 AS b FROM seg), c AS (
 SELECT doc_id, idx, CAST(idx + 1 AS VARCHAR) || chr(10) || lpad(CAST(a // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(a // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(a // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(a % 1000 AS VARCHAR), 3, '0') || ' --> ' ||
 lpad(CAST(b // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(b // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(b // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(b % 1000 AS VARCHAR), 3, '0') || chr(10) || trim(text, ' ') || chr(10) AS cue FROM m)
SELECT doc_id, md5(string_agg(cue, chr(10) ORDER BY idx)) AS srt_md5 FROM c GROUP BY doc_id""")
def srt_sink_text(spark, d):
    ms = lambda c: F.floor(F.col(c) * 1000 / 15).cast("long")
    s = _seg(spark, d).select("doc_id", "idx", "text", ms("start_c").alias("start_ms"), ms("end_c").alias("end_ms"))
    return sinks.srt_text(s, ["doc_id"]).select("doc_id", F.md5(F.col("srt").cast("binary")).alias("srt_md5"))


@query("SELECT doc_id, array_to_string(list_filter([trim(lang, ' '), trim(source, ' '), trim(' ' || lang, ' '), ''], lambda x: x <> '')[1:2], ',') AS tags FROM documents")
def dedup_normalise_list(spark, d):
    raw = F.array(F.col("lang"), F.col("source"), F.concat(F.lit(" "), F.col("lang")), F.lit(""), F.col("source"))
    return table(spark, d, "documents").select("doc_id", F.array_join(X.distinct_list(raw), ",").alias("tags"))


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, substr(md5(event_type || '|' || CAST(event_id AS VARCHAR)), 1, 12) AS id FROM events")
def json_props_and_ids(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})["k"].alias("k"), F.substring(F.md5(F.concat_ws("|", "event_type", F.col("event_id").cast("string")).cast("binary")), 1, 12).alias("id"))


@query("SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 150) || ' ... ' || right(text, 150) END AS trimmed FROM documents")
def head_tail_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.head_tail(F.col("text"), 150, 150, " ... ").alias("trimmed"))


# --- catalogue ---------------------------------------------------------------------------

POOL = """pool AS (SELECT d.doc_id AS clip_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'pending' END AS status, source, lang,
  d.doc_id % 7 = 0 AS blocked, d.doc_id % 5 = 0 AS other_only, d.doc_id % 11 = 0 AS posted FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
JOBS = """jobs AS (SELECT event_id, user_id, 'a' || CAST(user_id AS VARCHAR) AS account, event_id % 1000 AS clip_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'draft_ready' WHEN 'purchase' THEN 'posted' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status, ts,
  CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN 'soon' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS scheduled_for FROM events)"""


def _pool(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").withColumnRenamed("doc_id", "_d")
    none = F.array().cast("array<string>")
    when = lambda n, who: F.when(F.col("doc_id") % n == 0, F.array(F.lit(who)))
    j = docs.select("doc_id", "source", "lang").join(labels, F.col("doc_id") == F.col("_d"), "left")
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("pending")
    return j.select(F.col("doc_id").alias("clip_id"), status.alias("status"), "source", F.array("lang").alias("tags"), when(7, "a1").alias("blocked_accounts"), when(5, "a2").otherwise(none).alias("allowed_accounts"), when(11, "a1").alias("posted_accounts"))


def _jobs(spark, d, events=None):
    e = table(spark, d, "events") if events is None else events
    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "draft_ready").when(F.col("event_type") == "purchase", "posted").when(F.col("event_type") == "error", "failed").otherwise("cancelled")
    text = F.when(F.col("event_id") % 50 == 0, None).when(F.col("event_id") % 50 == 1, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("event_id", "user_id", F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("account"), (F.col("event_id") % 1000).alias("clip_id"), status.alias("status"), "ts", text.alias("scheduled_for"))


@query("WITH " + POOL + " SELECT source, count(*) AS total, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'rejected') AS rejected FROM pool GROUP BY source")
def pool_status_counts(spark, d):
    return catalog.status_counts(_pool(spark, d), ["source"], ["approved", "pending", "rejected"])


@query("WITH " + JOBS + " SELECT account, count(*) AS total, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'draft_ready') AS draft_ready, count(*) FILTER (status = 'posted') AS posted, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('queued', 'draft_ready') AND ts >= TIMESTAMP '2024-01-15') AS upcoming FROM jobs GROUP BY account")
def queue_status_counts(spark, d):
    j = _jobs(spark, d)
    up = j.groupBy("account").agg(F.count_if(F.col("status").isin("queued", "draft_ready") & (F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))).alias("upcoming"))
    return catalog.status_counts(j, ["account"], ["queued", "draft_ready", "posted", "failed"]).join(up, "account")


@query("WITH " + POOL + ", " + JOBS + """ SELECT clip_id, source FROM pool WHERE status = 'approved' AND lang = 'en' AND NOT blocked AND NOT other_only AND NOT posted
AND clip_id NOT IN (SELECT clip_id FROM jobs WHERE account = 'a1' AND CAST(ts AS DATE) = DATE '2024-01-10' AND status NOT IN ('cancelled', 'failed'))""")
def eligible_documents(spark, d):
    busy = _jobs(spark, d).filter((F.col("account") == "a1") & (F.to_date("ts") == F.lit("2024-01-10").cast("date")) & ~F.col("status").isin(*schedule.CLOSED)).select("clip_id").distinct()
    return _pool(spark, d).filter(catalog.eligible(F.lit("a1"), F.lit("en"))).join(busy, "clip_id", "left_anti").select("clip_id", "source")


@query("WITH " + JOBS + " SELECT event_id, account, scheduled_for FROM jobs WHERE status = 'queued' AND (scheduled_for IS NULL OR (scheduled_for <> 'soon' AND CAST(scheduled_for AS TIMESTAMP) <= TIMESTAMP '2024-01-08')) ORDER BY scheduled_for NULLS FIRST, event_id LIMIT 100")
def due_jobs(spark, d):
    j = _jobs(spark, d).filter((F.col("status") == "queued") & catalog.due(F.col("scheduled_for"), F.lit("2024-01-08T00:00:00").cast("timestamp")))
    return j.orderBy(F.asc_nulls_first("scheduled_for"), "event_id").limit(100).select("event_id", "account", "scheduled_for")


@query("WITH " + JOBS + " SELECT account, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER (status NOT IN ('cancelled', 'failed')) AS n FROM jobs GROUP BY ALL")
def jobs_per_account_day(spark, d):
    return _jobs(spark, d).groupBy("account", F.to_date("ts").cast("string").alias("day")).agg(F.count_if(~F.col("status").isin(*schedule.CLOSED)).alias("n"))


@query("WITH " + JOBS + """, half AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS t FROM jobs) SELECT event_id, clip_id, account FROM jobs j, half WHERE j.ts >= half.t
AND NOT EXISTS (SELECT 1 FROM jobs a WHERE a.clip_id = j.clip_id AND a.account = j.account AND a.ts < half.t AND a.status NOT IN ('cancelled', 'failed', 'posted'))""")
def active_job_guard(spark, d):
    """All events: those of the later half of the time are judged by those before."""
    j = _jobs(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    j = j.crossJoin(j.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("half")))
    return catalog.without_active_job(j.filter("ts >= half"), j.filter("ts < half"), ["clip_id", "account"], ["cancelled", "failed", "posted"]).select("event_id", "clip_id", "account")


@query("WITH " + POOL + """, r AS (SELECT clip_id, source, md5('7|' || CAST(clip_id AS VARCHAR)) AS rnd FROM pool WHERE status = 'approved'), k AS (SELECT *, CASE WHEN coalesce(source, '') <> '' AND row_number() OVER (PARTITION BY source ORDER BY rnd, clip_id) = 1 THEN 0 ELSE 1 END AS again FROM r)
SELECT clip_id, source, row_number() OVER (ORDER BY again, rnd, clip_id) AS place FROM k QUALIFY place <= 30""")
def diverse_pick(spark, d):
    return catalog.diverse_pick(_pool(spark, d).filter("status = 'approved'").select("clip_id", "source"), "clip_id", "source", "7", 30)


_US = lambda n, i: f"(((2 * {i} + 1) * 50400000000 + {n}) // (2 * {n}))"
_SLOT = lambda day, n, i: f"{day} || 'T' || strftime(TIMESTAMP '2000-01-01' + to_microseconds(28800000000 + {_US(n, i)}), '%H:%M:%S') || CASE WHEN {_US(n, i)} % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST({_US(n, i)} % 1000000 AS VARCHAR), 6, '0') END"


@query(f"""SELECT event_id, unnest(list_transform(range(0, n), lambda i: {_SLOT("strftime(CAST(ts AS DATE), '%Y-%m-%d')", "n", "i")})) AS slot FROM (SELECT event_id, ts, event_id % 17 AS n FROM events) WHERE n > 0""")
def slot_plan(spark, d):
    """Posting times from 8 to 22 o'clock for every event's day, 0 to 16 of them."""
    return table(spark, d, "events").select("event_id", F.explode(catalog.slots(F.to_date("ts"), F.col("event_id") % 17)).alias("slot"))


# in January the zone is five hours behind
PLAN = "WITH " + POOL + ", " + JOBS + f""", day AS (SELECT * FROM jobs WHERE account = 'a1' AND scheduled_for <> 'soon' AND CAST(CAST(nullif(scheduled_for, 'soon') AS TIMESTAMP) - INTERVAL 5 HOUR AS DATE) = DATE '2024-01-10'), mine AS (SELECT * FROM day WHERE status NOT IN ('cancelled', 'failed')),
need AS (SELECT greatest(0, {{target}} - count(*)) AS n FROM mine), fit AS (SELECT clip_id, source, lang, md5('s|2024-01-10|' || CAST(clip_id AS VARCHAR)) AS rnd FROM pool WHERE status = 'approved' AND {{tagged}} AND NOT blocked AND NOT other_only AND NOT posted AND clip_id NOT IN (SELECT clip_id FROM mine)),
k AS (SELECT *, CASE WHEN coalesce(source, '') <> '' AND row_number() OVER (PARTITION BY source ORDER BY rnd, clip_id) = 1 THEN 0 ELSE 1 END AS again FROM fit), p AS (SELECT clip_id, source, lang, row_number() OVER (ORDER BY again, rnd, clip_id) AS r FROM k QUALIFY r <= (SELECT n FROM need)),
sl AS (SELECT unnest(list_transform(range(0, {{target}}), lambda i: {_SLOT("'2024-01-10'", "{target}", "i")} || '-05:00')) AS slot), fr AS (SELECT slot, row_number() OVER (ORDER BY slot) AS r FROM sl WHERE slot NOT IN (SELECT scheduled_for FROM day WHERE scheduled_for IS NOT NULL))"""


@query(PLAN.format(target=40, tagged="lang = 'en'") + """ SELECT clip_id, slot, md5('a1|' || CAST(clip_id AS VARCHAR) || '|' || slot) AS job_id, 'tiktok' AS platform, lang || chr(10) || translate(source, '-_', '  ') AS caption, '#islam #muslim #reminder' AS hashtags FROM p JOIN fr USING (r)""")
def daily_plan(spark, d):
    """A day of an account: local dates, posting hours, a tag, closed jobs keep their slots."""
    plan = schedule.daily_plan(_pool(spark, d), _jobs(spark, d), "a1", "2024-01-10", per_day=40, tag="en", seed="s")
    return plan.select("clip_id", F.col("scheduled_for").alias("slot"), "job_id", "platform", F.col("caption_text").alias("caption"), F.array_join("hashtags", " ").alias("hashtags"))


@query(r"""SELECT page_id FROM (SELECT page_id, regexp_split_to_array(lower(regexp_extract(html, '<title>([^<]*)', 1)), '[\s,;|/()\[\]]+') AS t FROM pages) WHERE NOT list_has_any(t, ['the', 'der', 'les'])""")
def scenic_filter(spark, d):
    return table(spark, d, "pages").filter(catalog.without_terms(F.regexp_extract("html", "<title>([^<]*)", 1), ["the", "der", "les"])).select("page_id")


HITS = """hits AS (SELECT page_id, regexp_extract(url, '\\.example\\.(com|net|org)', 1) AS provider, page_id % 40 AS q, 400 + page_id * 13 % 1000 AS width, 400 + page_id * 29 % 1000 AS height FROM pages)"""


def _hits(spark, d):
    i = F.col("page_id")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"\.example\.(com|net|org)", 1).alias("provider"), (i % 40).alias("q"), (400 + i * 13 % 1000).alias("width"), (400 + i * 29 % 1000).alias("height"))


@query("WITH " + HITS + " SELECT q, provider, page_id FROM (SELECT *, dense_rank() OVER (PARTITION BY q ORDER BY CASE provider WHEN 'net' THEN 0 WHEN 'org' THEN 1 ELSE 2 END) AS r FROM hits) WHERE r = 1")
def provider_preference(spark, d):
    p = F.when(F.col("provider") == "net", 0).when(F.col("provider") == "org", 1).otherwise(2)
    return catalog.first_of_providers(_hits(spark, d), ["q"], p).select("q", "provider", "page_id")


@query("WITH " + HITS + " SELECT q, page_id AS file_id, width, height FROM hits QUALIFY row_number() OVER (PARTITION BY q ORDER BY height > width DESC, width * height DESC, page_id) = 1")
def best_rendition(spark, d):
    return catalog.best_rendition(_hits(spark, d).withColumnRenamed("page_id", "file_id"), ["q"])


@query("WITH " + HITS + " SELECT q, provider, page_id, width FROM hits WHERE page_id % 3 <> 0 AND (provider, page_id) NOT IN (SELECT provider, page_id FROM hits WHERE page_id % 2 = 0) UNION ALL SELECT q, provider, page_id, width + 1 FROM hits WHERE page_id % 2 = 0")
def upsert_manifest(spark, d):
    """A keyed table written, then brought up to date in place."""
    h = _hits(spark, d).select("q", "provider", "page_id", "width")
    kept = KeyedTable(spark, shared_folder(spark, "manifest"), ["provider", "page_id"], 16)
    kept.write(h.filter("page_id % 3 <> 0"))
    kept.upsert(h.filter("page_id % 2 = 0").withColumn("width", F.col("width") + 1))
    return kept.read()


@query("WITH " + HITS + """, o AS (SELECT page_id, provider, width, q FROM hits WHERE page_id % 3 <> 0), n AS (SELECT page_id, provider, width + 1 AS width, q + 100 AS q FROM hits WHERE page_id % 2 = 0)
SELECT coalesce(o.page_id, n.page_id) AS page_id, coalesce(o.provider, n.provider) AS provider, coalesce(n.width, o.width) AS width, coalesce(o.q, n.q) AS q FROM o FULL JOIN n ON o.page_id = n.page_id""")
def pool_sync(spark, d):
    """A keyed table written, then refreshed in place: new keys come in, of known ones the width is taken."""
    h = _hits(spark, d).select("page_id", "provider", "width", "q")
    pool = KeyedTable(spark, shared_folder(spark, "pool"), ["page_id"], 16)
    pool.write(h.filter("page_id % 3 <> 0"))
    pool.refresh(h.filter("page_id % 2 = 0").withColumns({"width": F.col("width") + 1, "q": F.col("q") + 100}), ["width"])
    return pool.read()


@query("""SELECT doc_id, 'labels' AS source_name, CAST(quality AS VARCHAR) AS value FROM labels UNION ALL SELECT doc_id, 'documents', lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def source_cascade(spark, d):
    a = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("value"))
    b = table(spark, d, "documents").select("doc_id", F.col("lang").alias("value"))
    return readers.first_available([("labels", a), ("documents", b)], ["doc_id"])


@query("SELECT d.doc_id, d.lang, b.item_id FROM documents d JOIN benchmark b ON b.item_id = d.doc_id")
def corpus_intersection(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "benchmark"), F.col("item_id") == F.col("doc_id")).select("doc_id", "lang", "item_id")


@query("WITH b AS (SELECT c.conv_id, c.turn, c.role, (c.conv_id + c.turn) % 4 AS slot FROM conversations c), a AS (SELECT DISTINCT conv_id, turn AS slot, length(text) AS asset FROM conversations WHERE turn < 3), m AS (SELECT conv_id, min_by(asset, slot) AS fallback FROM a GROUP BY conv_id) SELECT b.conv_id, b.turn, b.role, coalesce(a.asset, m.fallback) AS asset FROM b LEFT JOIN a ON a.conv_id = b.conv_id AND a.slot = b.slot LEFT JOIN m ON m.conv_id = b.conv_id")
def beats_with_assets(spark, d):
    c = table(spark, d, "conversations")
    b = c.select("conv_id", "turn", "role", ((F.col("conv_id") + F.col("turn")) % 4).alias("slot"))
    a = c.filter("turn < 3").select(F.col("conv_id").alias("_c"), F.col("turn").alias("_s"), F.length("text").cast("long").alias("asset")).distinct()
    m = a.groupBy(F.col("_c").alias("_m")).agg(F.min_by("asset", "_s").alias("fallback"))
    j = b.join(a, (F.col("conv_id") == F.col("_c")) & (F.col("slot") == F.col("_s")), "left").join(m, F.col("conv_id") == F.col("_m"), "left")
    return j.select("conv_id", "turn", "role", F.coalesce("asset", "fallback").alias("asset"))


@query("WITH " + JOBS + """, p AS (SELECT clip_id, account, min(ts) AS first, max(ts) AS last, count(*) AS n FROM jobs WHERE status = 'posted' GROUP BY ALL), old AS (SELECT doc_id AS clip_id, doc_id % 3 AS n0, CASE WHEN doc_id % 11 = 0 THEN 'a1' END AS who FROM documents),
g AS (SELECT p.clip_id, sum(p.n) AS n, max(p.last) AS last, string_agg(p.account, ',' ORDER BY p.first, p.account) FILTER (o.who IS NULL OR p.account <> o.who) AS who FROM p JOIN old o USING (clip_id) GROUP BY ALL)
SELECT o.clip_id, CAST(o.n0 + coalesce(g.n, 0) AS BIGINT) AS post_count, concat_ws(',', o.who, g.who) AS posted_accounts, strftime(g.last, '%Y-%m-%dT%H:%M:%S') AS last_posted_at FROM old o LEFT JOIN g USING (clip_id)""")
def posted_updates(spark, d):
    i = F.col("doc_id")
    pool = table(spark, d, "documents").select(i.alias("clip_id"), (i % 3).alias("post_count"), F.when(i % 11 == 0, F.array(F.lit("a1"))).alias("posted_accounts"), F.lit(None).cast("timestamp").alias("last_posted_at"))
    jobs = _jobs(spark, d).withColumn("posted_at", F.col("ts").cast("timestamp"))
    out = catalog.posted_updates(pool, jobs)
    return out.select("clip_id", "post_count", F.array_join("posted_accounts", ",").alias("posted_accounts"), F.date_format("last_posted_at", "yyyy-MM-dd'T'HH:mm:ss").alias("last_posted_at"))


@query("WITH " + JOBS + """ SELECT event_id, CASE WHEN user_id % 3 > 0 AND user_id % 5 > 0 THEN 't' || user_id END AS access_token,
  CASE WHEN user_id % 3 = 0 THEN 'account not found: ' || account WHEN user_id % 5 = 0 THEN 'missing access_token for account: ' || account END AS error FROM jobs""")
def jobs_with_accounts(spark, d):
    j = _jobs(spark, d)
    u = F.col("user_id")
    accounts = j.filter(u % 3 > 0).select("account", F.when(u % 5 > 0, F.concat(F.lit(" t"), u.cast("string"))).otherwise(" ").alias("access_token")).distinct()
    return catalog.with_account(j, accounts).select("event_id", "access_token", "error")


@query("WITH " + JOBS + """ SELECT event_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS first, strftime(t + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS after,
  status IN ('queued', 'draft_ready') AND scheduled_for IS NOT NULL AND scheduled_for <> 'soon' AND ts >= TIMESTAMP '2024-01-15' AS upcoming
FROM (SELECT *, CASE WHEN scheduled_for <> 'soon' THEN date_trunc('day', ts) END AS t FROM jobs)""")
def day_bounds(spark, d):
    j = _jobs(spark, d)
    first, after = catalog.day_bounds(F.substring("scheduled_for", 1, 10))
    up = catalog.upcoming(F.col("status"), F.try_to_timestamp("scheduled_for"), F.lit("2024-01-15T00:00:00").cast("timestamp"))
    return j.select("event_id", F.date_format(first, "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format(after, "yyyy-MM-dd HH:mm:ss").alias("after"), up.alias("upcoming"))


@query(PLAN.format(target=41, tagged="true") + """ SELECT 'a1__2024-01-10' AS plan_key, (SELECT count(*) FROM mine) AS existing, (SELECT count(*) FROM p JOIN fr USING (r)) AS created, greatest(0, 41 - (SELECT count(*) FROM mine) - (SELECT count(*) FROM p JOIN fr USING (r))) AS unfilled,
  (SELECT string_agg(CAST(clip_id AS VARCHAR), ',' ORDER BY slot) FROM p JOIN fr USING (r)) AS clips, 8 AS start_hour, 'new' AS updated_at UNION ALL SELECT 'a2__2024-01-10', 1, 2, 0, '', 9, 'old'""")
def recorded_plans(spark, d):
    """The table of plans after a day's plan was written in place: it replaces an older one, other accounts' stay."""
    pool, jobs = _pool(spark, d), _jobs(spark, d)
    plans = KeyedTable(spark, shared_folder(spark, "plans"), ["plan_key"], 4)
    queue = KeyedTable(spark, shared_folder(spark, "queue"), ["job_id"], 16)
    queue.write(jobs.select(F.col("event_id").cast("string").alias("job_id"), "status", F.lit("tiktok").alias("platform"), "account", "clip_id", *[F.lit("").alias(c) for c in ("path", "source", "preset", "caption_text")], F.array().cast("array<string>").alias("hashtags"), "scheduled_for", *[F.lit("").alias(c) for c in ("created_at", "updated_at", "notes", "external_post_id")]))
    old = schedule.plan_row(queue.read().limit(0), jobs, "a1", "2024-01-10", at="old")
    other = {"plan_key": F.lit("a2__2024-01-10"), "account": F.lit("a2"), "existing": F.lit(1).cast("long"), "created": F.lit(2).cast("long"), "unfilled": F.lit(0).cast("long"), "start_hour": F.lit(9)}
    plans.write(old.unionByName(old.withColumns(other)))
    schedule.write_day(pool, queue, plans, shared_folder(spark, "history"), "a1", "2024-01-10", "new", seed="s", per_day=41)
    got = plans.read()
    return got.select("plan_key", "existing", "created", F.col("unfilled").cast("long").alias("unfilled"), F.array_join(F.transform("jobs", lambda j: j["clip_id"].cast("string")), ",").alias("clips"), "start_hour", "updated_at")


@query("WITH " + JOBS + " SELECT clip_id, status, event_id FROM jobs QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY ts DESC, event_id DESC) = 1")
def last_job_status(spark, d):
    j = _jobs(spark, d).select("clip_id", "ts", "event_id", "status")
    return catalog.last_status(j, "clip_id", "ts").select("clip_id", "status", "event_id")


@query("WITH g AS (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS roles, bool_or(role = 'system') AS has_system, string_agg(role, '>' ORDER BY turn) AS path FROM conversations GROUP BY conv_id) SELECT conv_id, n, roles, CASE WHEN has_system THEN 'guided' ELSE 'plain' END AS mode, path FROM g")
def conversation_modes(spark, d):
    listed = F.sort_array(F.collect_list(F.struct("turn", "role")))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct("role").alias("roles"), F.bool_or(F.col("role") == "system").alias("s"), F.array_join(F.transform(listed, lambda x: x["role"]), ">").alias("path"))
    return g.select("conv_id", "n", "roles", F.when(F.col("s"), "guided").otherwise("plain").alias("mode"), "path")


# --- streaming ---------------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def history_stream(spark, d):
    """Hourly counts of the event history, read as a stream to its present end; a batch writes the hours that it changed."""
    counts = KeyedTable(spark, shared_folder(spark, "hourly"), ["hour", "event_type"], 8)
    stream = history.hourly_counts(event_stream(spark, d)).writeStream.outputMode("update")
    run = stream.foreachBatch(lambda b, i: counts.upsert(b, once=("hourly", i))).option("checkpointLocation", shared_folder(spark, "state"))
    run.trigger(availableNow=True).start().awaitTermination()
    return counts.read()


def event_stream(spark, d):
    """All events as a stream; the table may be one file or a folder of files."""
    schema = table(spark, d, "events").schema
    # one file: its folder is read with a name filter
    events = history.read_stream(spark, f"{d}/", schema, glob="events.parquet") if not _is_folder(spark, f"{d}/events.parquet") else history.read_stream(spark, f"{d}/events.parquet", schema)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


from . import queries_matching, queries_publishing  # noqa: E402, F401  (they register their queries)
