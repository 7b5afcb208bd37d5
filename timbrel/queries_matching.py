"""Queries of matching and transcript repair: windows of document segments against benchmark items, items against documents.

The similarity of characters has no SQL form. The queries with a DuckDB statement leave it out of the score
(``char=False``), those without one have the whole score and are tested against plain rules.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as X
from .operators import matching, retrieval, text_index
from .plans import repair
from .queries import _FOLD, SEG, _corpus, _seg, _sides, query
from .sources.readers import table
from .sources.store import KeyedTable, settled, shared_folder

# src (sid, l) and cor (cid, l) go in; m (sid, cid, score, nxt, a, z, mode, wo4, bo4, hits, accepted) of scores of .60 and more comes out
MATCH = """st AS (SELECT sid, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS p FROM src), ct AS (SELECT cid, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS p FROM cor), nn AS (SELECT count(*) AS n FROM cor),
wt AS (SELECT t, CAST(round(round(1.0 + ln((n + 1.0) / (df + 1)), 4) * 10000) AS BIGINT) AS w, df > 0.08 * n AS common FROM (SELECT t, count(DISTINCT cid) AS df FROM ct WHERE length(t) >= 2 GROUP BY t), nn),
sb AS (SELECT sid, t, count(*) AS n, min(p) AS first, list(p ORDER BY p) AS at FROM st GROUP BY ALL), cb AS (SELECT cid, t, count(*) AS n, list(p ORDER BY p) AS at FROM ct GROUP BY ALL),
an AS (SELECT s.sid, s.t, s.at, coalesce(w.w, 10000) AS w, row_number() OVER (PARTITION BY s.sid ORDER BY coalesce(w.w, 0) DESC, s.t) AS o FROM sb s LEFT JOIN wt w USING (t) WHERE length(s.t) >= 2 AND NOT coalesce(w.common, false)),
sg AS (SELECT sid, g, row_number() OVER (PARTITION BY sid ORDER BY first) AS o FROM (SELECT a.sid, a.t || ' ' || b.t AS g, min(a.p) AS first FROM st a JOIN st b ON b.sid = a.sid AND b.p = a.p + 1 JOIN an x ON x.sid = a.sid AND x.t = a.t JOIN an y ON y.sid = b.sid AND y.t = b.t GROUP BY 1, 2)),
cg AS (SELECT a.cid, a.t || ' ' || b.t AS g, list(a.p ORDER BY a.p) AS at FROM ct a JOIN ct b ON b.cid = a.cid AND b.p = a.p + 1 GROUP BY 1, 2),
v1 AS (SELECT sid, cid, sum(p) AS p FROM (SELECT sid, cid, 18 * w AS p FROM an JOIN cb USING (t) WHERE o <= 10 UNION ALL SELECT sid, cid, 240000 FROM sg JOIN cg USING (g) WHERE o <= 8) GROUP BY ALL),
few AS (SELECT sid FROM src LEFT JOIN v1 USING (sid) GROUP BY sid HAVING count(cid) < 20),
v2 AS (SELECT sid, cid, 35000 * count(*) AS p FROM (SELECT sid, t FROM sb JOIN few USING (sid) QUALIFY row_number() OVER (PARTITION BY sid ORDER BY first) <= 12) JOIN cb USING (t) GROUP BY sid, cid),
cand AS (SELECT v.sid, v.cid, len(s.l) AS n, len(c.l) AS m, CAST(sum(v.p) AS BIGINT) AS points, row_number() OVER (PARTITION BY v.sid ORDER BY sum(v.p) DESC, abs(len(c.l) - len(s.l)), v.cid) AS place
  FROM (SELECT * FROM v1 UNION ALL SELECT * FROM v2) v JOIN src s USING (sid) JOIN cor c USING (cid) GROUP BY v.sid, v.cid, s.l, c.l QUALIFY place <= 80),
sw AS (SELECT s.sid, coalesce(sum(w), 0) AS weight, count(w) AS anchors, any_value(g.n) AS grams, array_to_string(any_value(s.l), ' ') AS txt FROM src s LEFT JOIN an USING (sid) LEFT JOIN (SELECT sid, count(*) AS n FROM sg GROUP BY sid) g ON g.sid = s.sid GROUP BY s.sid),
f1 AS (SELECT sid, cid, sum(least(s.n, c.n)) AS common FROM cand JOIN sb s USING (sid) JOIN cb c USING (cid, t) GROUP BY ALL), f2 AS (SELECT sid, cid, sum(w) AS met4, count(*) AS hits FROM cand JOIN an USING (sid) JOIN cb USING (cid, t) GROUP BY ALL),
f3 AS (SELECT sid, cid, count(*) AS met FROM cand JOIN sg USING (sid) JOIN cg USING (cid, g) GROUP BY ALL),
fr AS (SELECT d.*, weight, anchors, txt, coalesce(hits, 0) AS hits, contains(array_to_string(c.l, ' '), txt) OR contains(txt, array_to_string(c.l, ' ')) AS inside,
  CASE WHEN weight > 0 THEN CAST(coalesce(met4, 0) AS DOUBLE) / CAST(weight AS DOUBLE) ELSE 0.0::DOUBLE END AS wo, CASE WHEN grams > 0 THEN CAST(coalesce(met, 0) AS DOUBLE) / CAST(grams AS DOUBLE) ELSE 0.0::DOUBLE END AS bo,
  2.0::DOUBLE * CAST(coalesce(common, 0) AS DOUBLE) / CAST(n + m AS DOUBLE) AS f1 FROM cand d JOIN sw USING (sid) JOIN cor c USING (cid) LEFT JOIN f1 USING (sid, cid) LEFT JOIN f2 USING (sid, cid) LEFT JOIN f3 USING (sid, cid)),
fs AS (SELECT *, CAST(floor(wo * 10000 + 0.5::DOUBLE) AS BIGINT) AS wo4, CAST(floor(bo * 10000 + 0.5::DOUBLE) AS BIGINT) AS bo4, {score} AS score FROM fr),
rk AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY score DESC, place) AS r FROM fs QUALIFY r <= 20),
pl AS (SELECT sid, cid, x.at AS own, y.at AS there, false AS g FROM rk JOIN an x USING (sid) JOIN cb y USING (cid, t) WHERE x.o <= 6 AND rk.n >= 3 AND rk.m >= 3 AND rk.hits >= 3 AND rk.wo4 >= 7200
  UNION ALL SELECT sid, cid, [0], y.at, true FROM rk JOIN sg x USING (sid) JOIN cg y USING (cid, g) WHERE x.o <= 6 AND rk.n >= 3 AND rk.m >= 3 AND rk.hits >= 3 AND rk.wo4 >= 7200),
po AS (SELECT sid, cid, unnest(own[1:3]) AS own, there[1:CASE WHEN g THEN 4 ELSE 5 END] AS there FROM pl), pt AS (SELECT sid, cid, own, unnest(there) AS there FROM po),
sr AS (SELECT sid, cid, s, n, m FROM (SELECT DISTINCT sid, cid, there - own + d AS s FROM pt, (SELECT unnest([-1, 0, 1]) AS d)) JOIN rk USING (sid, cid) WHERE s >= 0 AND s < m QUALIFY row_number() OVER (PARTITION BY sid, cid ORDER BY s) <= 40),
sp AS (SELECT sid, cid, s, s + k AS e, n AS n0, m AS m0, k AS len, c.l[s + 1 : s + k] AS l FROM (SELECT *, unnest(range(greatest(2, n - 1), least(m, n + 2) + 1)) AS k FROM sr) JOIN cor c USING (cid) WHERE s + k <= m),
sx AS (SELECT sid, cid, s, e, unnest(l) AS t, generate_subscripts(l, 1) AS p FROM sp), sc AS (SELECT sid, cid, s, e, t, count(*) AS n FROM sx GROUP BY ALL),
h1 AS (SELECT sid, cid, s, e, sum(least(sc.n, sb.n)) AS common FROM sc JOIN sb USING (sid, t) GROUP BY ALL), h2 AS (SELECT sid, cid, s, e, sum(w) AS met4, count(*) AS hits FROM sc JOIN an USING (sid, t) GROUP BY ALL),
h3 AS (SELECT sid, cid, s, e, count(*) AS met FROM (SELECT DISTINCT a.sid, a.cid, a.s, a.e, a.t || ' ' || b.t AS g FROM sx a JOIN sx b ON b.sid = a.sid AND b.cid = a.cid AND b.s = a.s AND b.e = a.e AND b.p = a.p + 1) JOIN sg USING (sid, g) GROUP BY ALL),
pr AS (SELECT sp.sid, sp.cid, sp.s, sp.e, n0 AS n, m0, len AS m, anchors, hits, contains(array_to_string(l, ' '), txt) OR contains(txt, array_to_string(l, ' ')) AS inside,
  CAST(met4 AS DOUBLE) / CAST(weight AS DOUBLE) AS wo, CASE WHEN grams > 0 THEN CAST(coalesce(met, 0) AS DOUBLE) / CAST(grams AS DOUBLE) ELSE 0.0::DOUBLE END AS bo, 2.0::DOUBLE * CAST(common AS DOUBLE) / CAST(n0 + len AS DOUBLE) AS f1
  FROM sp JOIN sw USING (sid) JOIN h1 USING (sid, cid, s, e) JOIN h2 USING (sid, cid, s, e) LEFT JOIN h3 USING (sid, cid, s, e)),
ps AS (SELECT *, CAST(floor(wo * 10000 + 0.5::DOUBLE) AS BIGINT) AS wo4, CAST(floor(bo * 10000 + 0.5::DOUBLE) AS BIGINT) AS bo4, {score} * CASE WHEN s > 0 AND e < m0 THEN 0.995::DOUBLE ELSE 1.0::DOUBLE END AS score FROM pr),
pb AS (SELECT * FROM (SELECT * FROM ps WHERE hits >= 2 AND wo4 >= 6000 QUALIFY row_number() OVER (PARTITION BY sid, cid ORDER BY score DESC, s, e) = 1) WHERE score >= 0.60::DOUBLE AND hits >= 3 AND wo4 >= 7200),
ls AS (SELECT rk.sid, list({{'cid': rk.cid, 'best': rk.score, 'nxt': 0.0::DOUBLE, 'a': NULL::BIGINT, 'z': NULL::BIGINT, 'mode': 'full', 'wo4': rk.wo4, 'bo4': rk.bo4, 'hits': rk.hits, 'p': pb.score, 's': pb.s, 'e': pb.e, 'pw': pb.wo4, 'pb': pb.bo4, 'ph': pb.hits}} ORDER BY r) AS l FROM rk LEFT JOIN pb USING (sid, cid) GROUP BY rk.sid),
lf AS (SELECT sid, list_reduce(list_prepend({{'cid': l[1].cid, 'best': l[1].best, 'nxt': coalesce(l[2].best, 0.0::DOUBLE), 'a': NULL::BIGINT, 'z': NULL::BIGINT, 'mode': 'full', 'wo4': l[1].wo4, 'bo4': l[1].bo4, 'hits': l[1].hits, 'p': NULL::DOUBLE, 's': NULL::BIGINT, 'e': NULL::BIGINT, 'pw': NULL::BIGINT, 'pb': NULL::BIGINT, 'ph': NULL::BIGINT}}, l),
  lambda a, x: CASE WHEN x.p > a.best + 0.012::DOUBLE THEN {{'cid': x.cid, 'best': x.p, 'nxt': greatest(a.nxt, a.best), 'a': x.s, 'z': x.e, 'mode': 'fragment', 'wo4': x.pw, 'bo4': x.pb, 'hits': x.ph, 'p': x.p, 's': x.s, 'e': x.e, 'pw': x.pw, 'pb': x.pb, 'ph': x.ph}}
  WHEN x.p > a.nxt THEN {{'cid': a.cid, 'best': a.best, 'nxt': x.p, 'a': a.a, 'z': a.z, 'mode': a.mode, 'wo4': a.wo4, 'bo4': a.bo4, 'hits': a.hits, 'p': x.p, 's': x.s, 'e': x.e, 'pw': x.pw, 'pb': x.pb, 'ph': x.ph}} ELSE a END) AS f FROM ls),
m AS (SELECT sid, f.cid AS cid, f.best AS score, f.nxt AS nxt, f.a AS a, f.z AS z, f.mode AS mode, f.wo4 AS wo4, f.bo4 AS bo4, f.hits AS hits, f.best - f.nxt >= 0.02::DOUBLE AND CASE WHEN f.mode = 'fragment' THEN f.hits >= 2 AND f.wo4 >= 5800 AND NOT (f.bo4 < 2200 AND f.hits < 3)
  ELSE NOT (f.hits = 0 AND f.wo4 < 5200) AND NOT (f.hits < 2 AND f.wo4 < 6000) END AS accepted FROM lf WHERE f.best >= 0.60::DOUBLE)""".format(
    score="""least(greatest((0.44::DOUBLE * wo + 0.24::DOUBLE * f1 + 0.18::DOUBLE * bo + 0.14::DOUBLE * 0.0::DOUBLE + CASE WHEN inside THEN 0.025::DOUBLE ELSE 0.0::DOUBLE END)
  * CASE WHEN CAST(least(n, m) AS DOUBLE) / CAST(greatest(n, m) AS DOUBLE) < 0.55::DOUBLE THEN 0.88::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN hits = 0 AND anchors >= 2 THEN 0.82::DOUBLE ELSE 1.0::DOUBLE END, 0.0::DOUBLE), 1.0::DOUBLE)"""
)
_LIST = f"list_filter(string_split({_FOLD}, ' '), lambda x: x <> '')"
_ITEMS = f"cor AS (SELECT item_id AS cid, {_LIST} AS l FROM benchmark)"
WINDOWS = SEG + f""", sw0 AS (SELECT doc_id, idx, text AS t1, lead(text, 1) OVER w AS t2, lead(text, 2) OVER w AS t3 FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
wn AS (SELECT doc_id, idx, 1 AS size, t1 AS text FROM sw0 UNION ALL SELECT doc_id, idx, 2, t1 || ' ' || t2 FROM sw0 WHERE t2 IS NOT NULL UNION ALL SELECT doc_id, idx, 3, t1 || ' ' || t2 || ' ' || t3 FROM sw0 WHERE t3 IS NOT NULL),
wl AS (SELECT doc_id, idx, size, {_LIST} AS l FROM wn), ws AS (SELECT doc_id, idx, size, l, md5(array_to_string(l, ' ')) AS sid FROM wl WHERE len(l) >= 4), src AS (SELECT sid, any_value(l) AS l FROM ws GROUP BY sid), {_ITEMS}, """ + MATCH
REPAIRED = WINDOWS + """, bw AS (SELECT doc_id, idx, size, cid, score, nxt, a, z, mode FROM ws JOIN m USING (sid) WHERE accepted QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY score DESC, wo4 DESC, bo4 DESC, size) = 1),
tl2 AS (SELECT doc_id, idx, size FROM bw b WHERE idx = (SELECT min(idx) FROM bw x WHERE x.doc_id = b.doc_id)
  UNION ALL SELECT doc_id, nidx, nsize FROM (SELECT t.doc_id, b.idx AS nidx, b.size AS nsize, row_number() OVER (PARTITION BY t.doc_id ORDER BY b.idx) AS r FROM tl2 t JOIN bw b ON b.doc_id = t.doc_id AND b.idx >= t.idx + t.size) WHERE r = 1),
tk AS (SELECT b.* FROM tl2 JOIN bw b USING (doc_id, idx)),
wd AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+'), lambda x: x <> '') AS words, text FROM benchmark),
sh AS (SELECT tk.*, CASE WHEN a >= 0 AND a < z AND z <= len(words) THEN array_to_string(words[a + 1 : z], ' ') ELSE wd.text END AS shown FROM tk JOIN wd ON wd.item_id = cid)"""


VOTED = "WITH src AS (SELECT doc_id AS sid, " + _LIST + f" AS l FROM documents), {_ITEMS}, " + MATCH[: MATCH.index("sw AS (")].rstrip().rstrip(",") + """
SELECT sid AS doc_id, cid AS item_id, points, place FROM cand
UNION ALL SELECT sid, cid, 0, row_number() OVER (PARTITION BY sid ORDER BY cid) FROM src, cor WHERE len(src.l) > 0 AND sid NOT IN (SELECT sid FROM v1) AND sid NOT IN (SELECT sid FROM v2)"""


@query(VOTED)
def voted_candidates(spark, d):
    """The 80 items with the most votes for each document of any language; a document without any vote has all."""
    docs, items = _sides(spark, d)
    idf, common = _corpus(items, "item_id")
    return retrieval.voted_candidates(docs, items, idf, "doc_id", "item_id", 80, common)


# whole rows alone: each document with its 80 items of most votes
SCORED = "WITH src AS (SELECT doc_id AS sid, " + _LIST + f" AS l FROM documents), {_ITEMS}, " + MATCH[: MATCH.index("rk AS (")].rstrip().rstrip(",")


@query(SCORED + " SELECT sid AS doc_id, cid AS item_id, place, score, wo, bo, hits FROM fs")
def match_score_no_char(spark, d):
    """Each document of any language with the items that it has voted for, scored without the similarity of characters."""
    return _document_scores(spark, d).select("doc_id", "item_id", "place", "score", "wo", "bo", "hits")


@query(SCORED + """, o AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY score DESC, cid) AS r FROM fs)
SELECT sid AS doc_id, max(CASE WHEN r = 1 THEN cid END) AS best, max(CASE WHEN r = 1 THEN score END) AS best_score, max(CASE WHEN r = 2 THEN score END) AS next_score FROM o WHERE r <= 2 GROUP BY sid""")
def best_and_runner_up(spark, d):
    return retrieval.best_and_next(_document_scores(spark, d), "doc_id", "score", "item_id")


@query(SCORED + """, o AS (SELECT *, row_number() OVER w AS r, score - coalesce(lead(score) OVER w, 0) AS margin FROM fs WINDOW w AS (PARTITION BY sid ORDER BY score DESC, cid))
SELECT sid AS doc_id, cid AS item_id, score, margin, score >= 0.30::DOUBLE AND margin >= 0.02::DOUBLE AND NOT (hits = 0 AND wo < 0.52::DOUBLE) AND NOT (hits < 2 AND wo < 0.60::DOUBLE) AS accepted FROM o WHERE r = 1""")
def match_accept(spark, d):
    """Each document's best item as a whole row, and whether it would do for a limit of .30; spans are in the queries of windows and items."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "item_id")
    o = _document_scores(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 2")  # two rows of a document move, not all
    o = o.withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))).filter("r = 1")
    ok = retrieval.accepted(F.col("score"), F.col("margin"), F.col("wo"), F.col("bo"), F.col("hits"), F.lit(False), 0.30, 0.02)
    return o.select("doc_id", "item_id", "score", "margin", ok.alias("accepted"))


def _document_scores(spark, d):
    index = text_index.build(_folded(spark, d, "benchmark", "item_id"), "item_id")
    return matching.voted_scores(_folded(spark, d, "documents", "doc_id").select("doc_id", "tokens"), index, "doc_id")


def _folded(spark, d, name, key):
    return table(spark, d, name).select(key, X.words(X.fold_latin(F.col("text"))).alias("tokens"), "text")


@query("WITH " + WINDOWS + """ SELECT sid AS text_id, cid AS item_id, CAST(floor(score * 10000 + 0.5::DOUBLE) AS BIGINT) AS score4, CAST(floor(nxt * 10000 + 0.5::DOUBLE) AS BIGINT) AS next4, a AS span_start, z AS span_end, mode, wo4, bo4, hits, accepted FROM m""")
def window_matches_no_char(spark, d):
    """Best item of each distinct text of a window of 1 to 3 segments, by the rules without the similarity of characters."""
    index = text_index.build(_folded(spark, d, "benchmark", "item_id"), "item_id")
    m = repair.match_texts(settled(repair.fit_windows(_seg(spark, d, 250), index, 3, 4, X.fold_latin, char=False), "match-windows"), index, char=False)
    return m.select(
        "text_id", "item_id", matching.tenthousandths(F.col("score")).alias("score4"), matching.tenthousandths(F.col("next_score")).alias("next4"),
        F.col("start").alias("span_start"), F.col("end").alias("span_end"), "mode", "wo4", "bo4", "hits", "accepted",
    )


@query("WITH RECURSIVE " + REPAIRED + """ SELECT s.doc_id, s.idx, h.idx IS NOT NULL AS matched, h.idx IS NOT NULL AND s.idx > h.idx AS absorbed, h.cid AS item_id, h.mode, h.a AS span_start, h.z AS span_end,
  CASE WHEN s.idx = h.idx THEN e.end_c ELSE s.end_c END AS end_c, CASE WHEN h.idx IS NULL THEN s.text WHEN s.idx = h.idx THEN h.shown ELSE '' END AS text
FROM seg s LEFT JOIN sh h ON h.doc_id = s.doc_id AND s.idx BETWEEN h.idx AND h.idx + h.size - 1 LEFT JOIN seg e ON e.doc_id = h.doc_id AND e.idx = h.idx + h.size - 1""")
def transcript_repair_no_char(spark, d):
    """Segments of all documents with canonical items written back, by scores without the similarity of characters."""
    return _repaired(spark, d, char=False)


@query()
def transcript_repair(spark, d):
    """The same by the whole score, with matches kept in a table of texts."""
    return _repaired(spark, d, cache=KeyedTable(spark, shared_folder(spark, "match-cache"), ["text_id"]))


def _repaired(spark, d, **how):
    canon = _folded(spark, d, "benchmark", "item_id")
    index = text_index.StoredIndex(spark, shared_folder(spark, "text-index"), "item_id")
    index.refresh(canon)
    out = repair.repair(_seg(spark, d, 250), canon, index.load(), X.fold_latin, **how)
    return out.select("doc_id", "idx", "matched", "absorbed", "item_id", "mode", "span_start", "span_end", "end_c", "text")


@query("WITH src AS (SELECT item_id AS sid, " + _LIST + " AS l FROM benchmark), cor AS (SELECT doc_id AS cid, " + _LIST + " AS l FROM documents), " + MATCH + """
SELECT sid AS item_id, cid AS doc_id, CAST(floor(score * 10000 + 0.5::DOUBLE) AS BIGINT) AS score4, CAST(floor(nxt * 10000 + 0.5::DOUBLE) AS BIGINT) AS next4, a AS span_start, z AS span_end, mode, wo4, bo4, hits, accepted FROM m""")
def item_spans_no_char(spark, d):
    """Each item's best document, whole or a span of it, by the rules without the similarity of characters."""
    m = _item_matches(spark, d, char=False)
    return m.select(
        "item_id", "doc_id", matching.tenthousandths(F.col("score")).alias("score4"), matching.tenthousandths(F.col("next_score")).alias("next4"),
        F.col("start").alias("span_start"), F.col("end").alias("span_end"), "mode", "wo4", "bo4", "hits", "accepted",
    )


@query()
def item_best_match(spark, d):
    """Each benchmark item's best document of any language, whole or a span of it, of all documents and all their spans."""
    return _item_matches(spark, d, k=None)


def _item_matches(spark, d, **how):
    items = _folded(spark, d, "benchmark", "item_id").select("item_id", "tokens")
    index = text_index.build(_folded(spark, d, "documents", "doc_id"), "doc_id", sources=items)
    return matching.best_matches(items, index, "item_id", **how)
