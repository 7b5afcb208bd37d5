"""Source divergence, filter interaction and shards against brute force, and on awkward rows."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from timbrel.llm import filter_audit, sharding, source_audit

from ..conftest import SF, canonical
from .test_operators import ALL, AWKWARD

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LABELS = [(4, 1, 0), (5, 0, 1), (8, 1, None), (9, 1, 0), (9, 1, 1), (None, 1, 1), (7, None, 1)]
MODULES = (source_audit, filter_audit, sharding)
#: More texts: terms in three documents of a language, a language whose terms are too rare, ties.
MORE = [
    *[(20 + i, f"Red ROUGE été {'red ' * i}tie knot", "en", "a" if i % 2 else "b", 1) for i in range(8)], *[(40 + i, "red tie", "en", None, 1) for i in range(3)],
    (50, "only here", "xx", "a", 1), (51, "and there", "xx", "b", 1), (52, "", "en", "z", 1), (53, "Ärger ärger red # A B C D", "en", "é", 1),
    *[(60 + i, "copy of a text with # and more", "de", "hot", 1) for i in range(12)],
]


@pytest.fixture(scope="module")
def rows():
    return AWKWARD + MORE


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, ALL)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def audited(rows, least=3, top=200):
    count, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall((text or "").translate(LOWER))
        count[lang, source].update(found)
        count[lang, None].update(found)
        seen[lang].update(set(found))
    vocabulary = {lang: {t for t, n in seen[lang].items() if n >= least} for lang, _ in groups}

    def chance(lang, source):
        c, v = count[lang, source], vocabulary[lang]
        total = sum(c[t] for t in v)
        return {t: 1 + (10**9 * (c[t] + 1)) // (total + len(v)) for t in v}

    out = []
    for lang, source in groups:
        p = chance(lang, source)
        pair = [(-sum((p[t] - q[t]) ** 2 // q[t] for t in p), other.encode(), other) for other_lang, other in groups if other_lang == lang and other != source for q in [chance(lang, other)]]
        q = chance(lang, None)
        term = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in p if count[lang, source][t] and p[t] > q[t]]
        for part, found, most in (("pair", pair, None), ("term", term, top)):
            out += [(lang, source, part, item, -value, i) for i, (value, _, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def interactions(rows, labels):
    first, failing = {}, defaultdict(list)
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    for doc_id, text, lang, *_ in rows:
        text, words = text or "", WORD.findall(text or "")
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)}
        fails |= {"D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and doc_id > first[text]}
        failing[lang or ""].append(({f for f in fails if fails[f]}, doc_id in good, doc_id in toxic))
    out = []
    for part, found in failing.items():
        removals, all_rows = Counter(), []
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [x for x in found if f in x[0] and not x[0] & before]
                removals[f] += len(gone)
                all_rows.append((f, [
                    part, "".join(order), step, sum(not x[0] & (before | {f}) for x in found), len(gone), sum(f in x[0] and bool(x[0] & before) for x in found),
                    sum(x[0] == {f} for x in found), sum(x[1] for x in gone), sum(x[2] for x in gone),
                ]))
        out += [tuple([*r, removals[f]]) for f, r in all_rows]
    return sorted(out)


def test_source_audit_equals_brute_force(docs, rows):
    assert collected(source_audit.source_audit(docs)) == audited(rows)


def test_ranks_stop_at_the_limit_and_rare_terms_go(docs, rows):
    assert collected(source_audit.source_audit(docs, least_docs=2, top=2)) == audited(rows, 2, 2)


def test_counts_beyond_nine_digits_stay_exact(spark):
    n, total, v = 9 * 10**15, 10**16, 12345
    row = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(source_audit.probability(F.col("n"), F.col("total"), F.col("v"))).first()
    assert row[0] == 1 + (10**9 * (n + 1)) // (total + v)


def test_filter_audit_equals_brute_force(docs, rows, labels):
    df = filter_audit.filter_audit(docs, labels)
    order = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert collected(df.select(order)) == interactions(rows, LABELS)


def test_each_filter_takes_its_share_of_all_orders(docs, rows, labels):
    found = filter_audit.filter_audit(docs, labels)
    last = {r.part: r.kept for r in found.filter("step = 5").select("part", "kept").distinct().collect()}
    shares = {r.part: r.s for r in found.filter("filter_order = 'ABCDE'").groupBy("part").agg(F.sum("shapley").alias("s")).collect()}
    sizes = Counter(r[2] or "" for r in rows)
    assert {p: 120 * (sizes[p] - last[p]) for p in sizes} == shares


@pytest.mark.parametrize("shards", [1, 3, 16, 50])
def test_shards_are_contiguous_even_and_whole(docs, rows, shards):
    found = sharding.shard_documents(docs, shards).collect()
    assert sorted(map(repr, [tuple(r)[:5] for r in found])) == sorted(map(repr, rows))
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r)
    assert min(by) >= 0 and max(by) < shards
    for at in by.values():
        assert sorted(r.slot for r in at) == list(range(len(at)))
    line = sorted(found, key=lambda r: (r.shard, r.slot))
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in line]
    assert ids == sorted(ids)
    sizes = [len((r.text or "").encode()) + 1 for r in line]
    upto, whole = 0, sum(sizes)
    for r, n in zip(line, sizes):  # by the middle byte
        assert r.shard == (2 * upto + n) * shards // (2 * whole)
        upto += n


def test_a_value_that_most_rows_share_is_cut(spark):
    same = spark.createDataFrame([(7, "x" * 9, "en", "a", 1)] * 400 + [(None, None, None, None, None)] * 200, ALL)
    found = sharding.shard_documents(same, 4).groupBy("shard").agg(F.sum(sharding.byte_size(F.col("text"))).alias("n")).collect()
    whole = 400 * 10 + 200
    assert len(found) == 4 and all(abs(r.n - whole / 4) <= 10 for r in found)


def test_shards_are_written_in_their_order(spark, docs, rows, tmp_path):
    sharding.write_shards(docs, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == len(rows) and {r.shard for r in back.select("shard").distinct().collect()} <= set(range(4))
    want = {(r.shard, r.slot, r.doc_id, r.text) for r in sharding.shard_documents(docs, 4).collect()}
    got = {(r.shard, r.slot, r.text) for r in back.collect()}
    assert got == {(s, n, t) for s, n, _, t in want}


def test_shard_query_has_sizes_and_checksums(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = sharding.QUERIES["op13_byte_shards"](spark, SF).collect()
    assert len(found) == len(texts)
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 1 and r.law == "bytes" and r.grown_shard is None for r in found)


@pytest.mark.parametrize("module", MODULES)
def test_query_matches_oracle(spark, duck, module):
    for name, sql in module.ORACLES.items():
        df = module.QUERIES[name](spark, SF)
        cur = duck.execute(sql)
        assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([c[0] for c in cur.description], cur.fetchall())


def test_empty_tables_give_none(spark, labels):
    nothing = spark.createDataFrame([], ALL)
    for df in (source_audit.source_audit(nothing), filter_audit.filter_audit(nothing, labels), sharding.shard_documents(nothing)):
        assert df.count() == 0


def test_no_labels_lose_none(spark, docs):
    found = filter_audit.filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert found.agg(F.sum(F.col("good_lost") + F.col("toxic_lost"))).first()[0] == 0


def test_extra_columns_may_have_any_name(docs, labels):
    names = ("term", "t", "z", "n", "d", "part", "digest", "first", "words", "A", "E", "good", "toxic", "chosen", "tie", "upto", "place", "place_", "before", "ahead", "start", "whole", "size", "shard", "slot")
    more, marks = docs.select("*", *[F.lit("clash").alias(c) for c in names]), labels.withColumn("digest", F.lit(1)).withColumn("part", F.lit("x"))
    assert collected(source_audit.source_audit(more)) == collected(source_audit.source_audit(docs))
    assert collected(filter_audit.filter_audit(more, marks)) == collected(filter_audit.filter_audit(docs, labels))
    kept = sharding.shard_documents(more, 5)
    assert {c for c in names} <= set(kept.columns) and kept.filter("place = 'clash' AND size = 'clash' AND tie = 'clash'").count() == docs.count()
    assert sorted(map(repr, kept.select("doc_id", "shard", "slot").collect())) == sorted(map(repr, sharding.shard_documents(docs, 5).select("doc_id", "shard", "slot").collect()))


def test_rows_of_plain_columns_stay_native(docs, labels):
    for df in (source_audit.source_audit(docs), filter_audit.filter_audit(docs, labels), sharding.shard_documents(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian", plan)
