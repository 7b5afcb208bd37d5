"""The training-data operators against brute force, and on awkward rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from timbrel.llm import ann, langid, mixing, near_dup, ngrams, packing, quality, quality_rules, substring_dup, suffix_dup, url_filter
from timbrel.llm.hilbert import hilbert_key
from timbrel.llm.suffix_array import suffix_array

from ..conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALL = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 8000
#: Null in each column, empty, blank, very long and repeated texts, ties, repeated rows.
AWKWARD = [
    (1, None, "en", "a", 1), (2, "", "en", "a", 0), (3, " \n\t ", None, None, None), (4, LONG, "de", "a", 5), (5, "a b c", "en", None, 3), (5, "a b c", "en", None, 3),
    (None, "no id at all", "en", "b", 4), (7, "ünïcode \U0001f600 text é", None, "b", 9), (8, "same words here once more again", "fr", "b", 3), (9, "same words here once more again", "fr", "b", 3),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, ALL)


@pytest.fixture(scope="module")
def clashing(awkward):
    names = ("label", "key", "id", "h", "n", "size", "target", "times", "cut", "rank", "doc", "marks", "fp", "ctx", "sig", "block", "score", "kept", "level", "prefix", "_t", "_w", "_r", "_many", "cut_version", "cut_doc", "cut_text", "cut_marks", "gone_doc", "gone_text", "mix_source", "mix_times", "mix_cut", "mix_copy", "mix_copy_")
    return awkward.select("*", *[F.lit("clash").alias(c) for c in names])


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], ALL)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 0), (8, 1, None), (None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")


def run_all(spark, docs, labels):
    return {
        "mix": mixing.mix(docs), "mix_rows": mixing.mix_rows(docs), "quality": quality.score_documents(docs, labels), "keep_good": quality.keep_good(docs, labels),
        "rules": quality_rules.quality_rules(docs), "pack": packing.pack(docs), "near": near_dup.near_duplicates(docs), "keep_first": near_dup.keep_first(docs),
        "substring": substring_dup.substring_dedup(docs), "cut": substring_dup.cut_repeats(docs), "suffix": suffix_dup.suffix_dedup(docs), "lang": langid.identify(docs, docs),
    }


def test_empty_tables_give_none(spark, nothing, labels):
    for name, df in run_all(spark, nothing, labels).items():
        assert df.count() == 0, name


def test_awkward_rows_and_clashing_columns(spark, awkward, clashing, labels):
    plain, other = run_all(spark, awkward, labels), run_all(spark, clashing, labels)
    one_per_row = {"mix", "quality", "rules", "near", "substring", "suffix", "lang"}
    for name, df in plain.items():
        rows = df.collect()
        if name in one_per_row:
            assert len(rows) == len(AWKWARD), name
        cols = [c for c in df.columns if c not in ("sequence_id", "step_group")]
        same = lambda x: sorted(repr(tuple(r)) for r in x.select(*cols).collect())
        assert same(df) == same(other[name]), name


def test_awkward_results(spark, awkward, labels):
    near = {r.doc_id: r for r in near_dup.near_duplicates(awkward).collect()}
    assert near[1].n_shingles == near[2].n_shingles == near[3].n_shingles == 0 and near[1].kept and near[3].component_id == 3
    assert near[9].component_id == 8 and not near[9].kept and near[5].component_id == 5 and near[None].kept
    lang = {r.doc_id: r for r in langid.identify(awkward, awkward).collect()}
    assert lang[1].lang_pred == lang[3].lang_pred == "und" and lang[4].lang_pred in ("en", "de", "fr")
    good = {r.doc_id: r for r in quality.score_documents(awkward, labels).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in good.values()) and good[1].score == good[2].score
    assert {r.doc_id for r in quality_rules.quality_rules(awkward).collect() if r.kept} == set()


def documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [(r.doc_id, r.text, r.source) for r in df.collect()]


@pytest.mark.parametrize("name", ["op1_mixing", "op2_url_filter", "op8_near_duplicates", "op9_substring_dedup"])
def test_queries_match_their_sql(spark, duck, name):
    from corpus_pipeline import ORACLES, QUERIES

    from ..conftest import canonical

    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([c[0] for c in cur.description], cur.fetchall())


def test_mix_meets_its_targets_and_repeats_itself(spark):
    df, _ = documents(spark)
    a, b = (sorted(map(repr, mixing.mix(x).collect())) for x in (df, df.repartition(7)))
    assert a == b
    rows = mixing.mix(df).collect()
    by = {}
    for r in rows:
        t = by.setdefault(r.source, [0, r.target, r.source_size, 0])
        t[0], t[3] = t[0] + r.taken, max(t[3], r["size"])
        assert r.taken <= 2 * r["size"]
    total = sum(v[2] for v in by.values())
    assert abs(sum(v[1] for v in by.values()) - 1.5 * total) < 1e-6 * total
    assert all(abs(taken - target) <= largest / 2 + 1e-6 and target <= 2 * size + 1e-6 for taken, target, size, largest in by.values())


def test_mix_rows_are_taken_rows(spark):
    df, _ = documents(spark)
    got = Counter(r.doc_id for r in mixing.mix_rows(df).select("doc_id").collect())
    want = {r.doc_id: r.taken // r["size"] for r in mixing.mix(df).collect() if r["size"]}
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in got.items() if want.get(k)}


def test_cuts_are_nested(spark):
    df, _ = documents(spark)
    taken = lambda p: {r.doc_id: r.taken // max(1, r["size"]) for r in mixing.mix(df, total_percent=p).collect()}
    low, high = taken(60), taken(90)
    assert all(low[k] <= high[k] for k in low)


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"), ("no scheme/de/", "", "", None, "allow"), ("http://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"), ("x://org", "org", "", None, "allow"),
        ("http://org/", "org", "/", "org/", "allow"), ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("http://notexample.com/de/#a", "notexample.com", "/de/", "com/de/", "block"),
        ("http://a.net/Casino", "a.net", "/Casino", None, "block"), ("http://a.net/casinos", "a.net", "/casinos", None, "allow"), ("http://a.net/free/win", "a.net", "/free/win", None, "block"), ("http://a.net/free/free", "a.net", "/free/free", None, "allow"),
        ("http://a.net?q=/x", "a.net", "", None, "allow"), ("://h/p://q", "h", "/p://q", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")
    r = url_filter.url_filter(df).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_urls_on_awkward_tables(spark):
    kind = "page_id long, url string, host string, rule string, weight string, _url string, _t string"
    assert url_filter.url_filter(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, "http://a.net/casino", *"xxxxx"), (1, "http://a.net/casino", *"xxxxx"), (None, "HTTP://B.NET/" + "y" * 200_000 + "/WIN/free", *"xxxxx"), (3, "", *"xxxxx")]
    got = url_filter.url_filter(spark.createDataFrame(rows, kind)).collect()
    assert [(r.page_id, r.verdict, r.weight) for r in got] == [(1, "block", 2), (1, "block", 2), (None, "block", 2), (3, "allow", 0)]
    heavy = url_filter.url_filter(spark.createDataFrame(rows, kind), vocabulary={"casino": 1}, limit=2).collect()
    assert [r.verdict for r in heavy] == ["allow"] * 4


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    key = hilbert_key(grid, 3)
    assert (np.sort(key) == np.arange(512)).all()
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours_recall_ties_and_bad_vectors(spark):
    r = np.random.default_rng(3)
    v = r.standard_normal((3000, 16))
    v[500:1500] = v[0]  # a third are copies
    rows = [(i, [float(x) for x in v[i].astype(np.float32)]) for i in range(3000)]
    rows += [(4000, None), (4020, [0.0] * 16), (4040, [None] + [1.0] * 15), (4060, [float("nan")] * 16), (4080, [float("inf")] * 16), (4100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for x in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(x.query_id, {})[x.rank] = (x.vec_id, x.score)
    e = np.array([x for _, x in rows[:3000]], dtype=np.float32).astype(np.float64)
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, near in got.items():
        s = (e * e[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:20]
        assert sorted(near) == list(range(1, 21))
        assert all(abs(s[i] - score) < 1e-12 for i, score in near.values())
        hits += len({i for i, _ in near.values()} & set(want.tolist()))
    assert hits >= 0.9 * 20 * len(got)
    assert [i for i, _ in (got[520][k] for k in range(1, 6))] == [0, 500, 501, 502, 503]
    assert ann.nearest(df.filter("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


def recall_of(spark, v, every, monkeypatch, **how):
    """Recall against brute force, and the curves and windows that were fitted."""
    fitted = []
    fit = ann._fitted
    monkeypatch.setattr(ann, "_fitted", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    n = len(v)
    path = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": [x.tolist() for x in v]}))
    got = {}
    for x in ann.nearest(path, F.col("vec_id") % every == 0, **how).collect():
        got.setdefault(x.query_id, {})[x.rank] = x.vec_id
    hits = 0
    for q, near in got.items():
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(set(near.values()) & set(np.lexsort((np.arange(n), -s))[:20].tolist()))
    assert set(got) == set(range(0, n, every))
    return hits / (20 * len(got)), fitted[0]


def test_recall_with_windows_far_below_the_table(spark, monkeypatch):
    r = np.random.default_rng(1)
    centres = r.standard_normal((400, 64))
    v = centres[r.integers(0, 400, 24_000)] + 0.25 * r.standard_normal((24_000, 64))
    recall, (curves, side) = recall_of(spark, v, 40, monkeypatch)
    assert recall >= 0.9 and curves > 1 and 20 * side < len(v)


def test_recall_without_clusters(spark, monkeypatch):
    v = np.random.default_rng(2).standard_normal((20_000, 64))
    recall, _ = recall_of(spark, v, 40, monkeypatch)
    assert recall >= 0.9


def test_windows_are_the_cheapest_that_hold_the_recall():
    rank = np.array([[500, 500], [500, 500]])
    near = np.array([[[510, 9000], [505, 9000]], [[9000, 510], [9000, 505]]])
    assert ann.cheapest(rank, near, 100_000, 1.0) == (2, ann.LEAST)
    assert ann.cheapest(rank, near, 600, 1.0) == (1, 8500)


def test_neighbours_on_awkward_tables(spark):
    kind = "vec_id long, embedding array<float>, q string, c string, v string, rank string"
    assert ann.nearest(spark.createDataFrame([], kind), F.col("vec_id") % 20 == 0).count() == 0
    rows = [(0, [1.0, 0.0], *"xxxx"), (0, [1.0, 0.0], *"xxxx"), (1, [0.5, 0.0], *"xxxx"), (2, [1.0, 0.0], *"xxxx"), (None, [9.0, 0.0], *"xxxx")]
    got = ann.nearest(spark.createDataFrame(rows, kind), F.col("vec_id") % 20 == 0).collect()
    assert [(x.query_id, x.rank, x.vec_id, x.score) for x in sorted(got, key=lambda x: x.rank)] == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]


def test_quality_votes_match_plain_cosines(spark):
    r = random.Random(8)
    good = [" ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(60)) for _ in range(40)]
    bad = [" ".join(r.choice("xyz") * 4 + "!!" for _ in range(60)) for _ in range(40)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, ALL)
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80) if i % 2], "doc_id long, quality int")
    m = quality.train(docs, labels)
    got = {x.doc_id: x.score for x in quality.score_documents(docs, labels).collect()}
    for i, t, *_ in rows:
        x = quality.embed([quality.counts(t, quality.ORDERS, quality.BITS, False)], m.idf, m.axes)[0]
        sims = sorted(((float(x @ y), float(k)) for y, k in zip(m.vectors, m.labels)), reverse=True)[: quality.NEIGHBOURS]
        total = sum(max(s, 0.0) ** quality.POWER for s, _ in sims)
        want = sum(max(s, 0.0) ** quality.POWER * k for s, k in sims) / total
        assert abs(got[i] - want) < 1e-3
    assert all((got[i] >= 0.3) == (i < 40) for i in got)


def test_repeated_words_are_marked():
    at, n = quality.counts("so so so it is", (2,), 12, False)
    want, m = quality.ngrams.counts(f"so {quality.REPEAT} {quality.REPEAT} it is", (2,), 12, False)
    assert at.tolist() == want.tolist() and n.tolist() == m.tolist()


def test_samples_stay_bounded(spark):
    rows = [(i % 700, "en" if i % 3 else "de", f"text {i}") for i in range(3000)]
    learn = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = ngrams.by_hash(learn.select("doc_id", "lang").distinct(), "lang", 50).groupBy("lang").count().collect()
    assert {x.lang: x["count"] for x in got} == {"en": 50, "de": 50}
    assert langid.train(learn, 50) is not None


def test_quality_on_held_out_rows(spark):
    from corpus_pipeline import QUERIES

    d = SF.replace("sf0.001", "sf0.1")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op4_quality_classifier"](spark, d).collect() if r.held_out and r.doc_id in truth]
    good, bad = [r.predicted for r in rows if truth[r.doc_id]], [1 - r.predicted for r in rows if not truth[r.doc_id]]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) > 0.9


def test_languages_on_held_out_rows(spark):
    from corpus_pipeline import QUERIES

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op10_language_id"](spark, SF).collect() if r.held_out]
    assert rows and sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.97


def test_text_statistics_match_a_plain_count(spark):
    df, docs = documents(spark)
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    for i, t, _ in docs:
        w = WORD.findall(t or "")
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_outliers_go_and_their_group_stays(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 9)))
    rows = [(i, " ".join(word() for _ in range(r.randint(80, 400))), "en", "s", 0) for i in range(300)]
    rows += [(1000 + i, " ".join(word() + "***" for _ in range(200)), "en", "s", 0) for i in range(20)]
    got = {x.doc_id: x.kept for x in quality_rules.quality_rules(spark.createDataFrame(rows, ALL)).collect()}
    assert not any(got[1000 + i] for i in range(20)) and sum(got[i] for i in range(300)) >= 298


def plain_mcd(x, h=0.75):
    """Concentration steps with exact subsets from the same two starts; squared distances by the better one."""
    p, n = x.shape[1], len(x)
    floor = np.diag(np.square(quality_rules.FLOORS))
    factor = h / quality_rules._chi2_cdf(quality_rules.chi2_quantile(h, p), p + 2)
    med = np.median(x, axis=0)
    best = None
    for m, c in ((med, np.diag((1.4826 * np.median(np.abs(x - med), axis=0)) ** 2)), (x.mean(axis=0), np.cov(x.T, bias=True))):
        for _ in range(60):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + floor), x - m)
            near = x[np.argsort(d)[: int(np.ceil(h * n))]]
            m, c = near.mean(axis=0), np.cov(near.T, bias=True) * factor
        det = np.linalg.slogdet(c + floor)[1]
        if best is None or det < best[0]:
            best = det, np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + floor), x - m)
    return best[1]


def test_distances_match_exact_estimates(spark):
    r = np.random.default_rng(4)
    a = r.standard_normal((400, 5)) @ np.diag([0.5, 0.8, 0.2, 0.3, 0.2]) + [5, 6, 0, 1, 0]
    b = r.standard_normal((300, 5)) * 0.4 + [3, 4, 1, 0, 0]
    b[:60] += [3, -2, 2, 1, 1]  # a fifth lies elsewhere
    rows = [(2, "x", g, *map(float, v), i) for g, xs in (("a", a), ("b", b)) for i, v in enumerate(xs)]
    df = spark.createDataFrame(rows, "level int, g_lang string, g_source string, " + ", ".join(f"{x} double" for x in quality_rules.X) + ", i int")
    got = quality_rules._join(df, quality_rules.mcd(df.drop("i")), quality_rules.KEY).select("g_source", "i", quality_rules._distance().alias("d")).collect()
    limit = quality_rules.chi2_quantile(1 - quality_rules.TAIL, 5) * quality_rules.TAIL_FACTOR
    for g, xs in (("a", a), ("b", b)):
        want, mine = plain_mcd(xs), np.array([x.d for x in sorted((x for x in got if x.g_source == g), key=lambda x: x.i)])
        assert ((want > limit) == (mine > limit)).all() and np.abs(np.log(mine / want)).max() < 0.2
    assert np.median(plain_mcd(b)[:60]) > 5 * np.median(plain_mcd(b)[60:])


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["Hello  <|endoftext|> <|ENDOFTEXT|> wörld's é \u0301x \x1c ab,. cd!! 12 日本 A.B,", None, "", "a " * 5000, "x" * 3000, LONG]
    _, docs = documents(spark)
    texts += [t for _, t, _ in docs[:40]]
    rows = list(enumerate(texts))
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {p.step_group for p in pieces}
    of: dict = {}
    for p in pieces:
        of.setdefault(p.doc_id, []).append(p)
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(of[i], key=lambda p: p.start):
            part = ids[p.start : p.start + p.length]
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p.length
        assert at == len(ids)
    seqs: dict = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length, p.sequence_tokens))
    for s in seqs.values():
        at = 0
        for offset, length, _ in sorted(s):
            assert offset == at
            at += length
        assert at == s[0][2] <= 2048 and at & (at - 1) == 0


def test_step_groups_get_about_the_same_tokens(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "POOL_TOKENS", 1 << 15)
    monkeypatch.setattr(packing, "STEP_TOKENS", 1 << 13)
    r = random.Random(6)
    texts = [" ".join(r.choices(["the", "of", "and", "a"], k=r.choice([30, 200, 900, 5000]))) for _ in range(150)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(150), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    groups, tiers = Counter(), {}
    for b in packing.pack_partition(iter([batch]), packing.tokenizer_path(), packing.TIERS, 1, 0):
        for x in b.to_pylist():
            groups[x["step_group"]] += x["length"]
            tiers.setdefault(x["step_group"], set()).add(x["tier"])
    full = sorted(groups.values())[1:]  # the partition's last may be smaller
    assert len(full) > 10 and max(full) <= 1.5 * min(full)


def test_another_tokenizer_encodes_whole_texts(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("byte_bpe_50k.json")
    assert not packing.Encoder(path).by_word
    (p,) = packing.pack(spark.createDataFrame([(1, "Hello  world. ünï")], "doc_id long, text string"), path).collect()[:1]
    assert p.doc_tokens == len(Tokenizer.from_file(path).encode("Hello  world. ünï", add_special_tokens=False).ids) + 1


def test_key_scheme_finds_all_pairs_under_the_distance():
    r = np.random.default_rng(1)
    for _ in range(300):
        a = r.integers(0, 1 << 16, near_dup.SYMBOLS).astype(np.uint16)
        b = a.copy()
        at = r.choice(near_dup.SYMBOLS, near_dup.DISTANCE, replace=False)
        b[at] ^= np.uint16(1)
        k = near_dup.keys_of(np.stack((a, b)))
        assert (k[0] == k[1]).any()


def test_near_duplicates_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    r = random.Random(2)
    base = [f"w{r.randint(0, 999)}" for _ in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(60)] = f"x{r.randint(0, 10**6)}"
        rows.append((i * 3 % 101, " ".join(w).upper() if i % 2 else " ".join(w)))
    rows += [(200 + i, "two words") for i in range(5)]
    sets = {}
    for i, t in rows:
        w = WORD.findall(t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates_under_one_id(spark):
    base = [f"a{i}" for i in range(60)]
    other = [f"b{i}" for i in range(60)]
    near = lambda w: " ".join([*w[:59], "z"])
    rows = [(1, " ".join(base)), (1, " ".join(other)), (2, near(other)), (3, near(base)), (4, None), (5, " ".join(f"c{i}" for i in range(60))), (5, " ".join(base)), (5, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.component_id, x.kept) for x in near_dup.near_duplicates(df).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 1, False), (5, 1, False), (5, 5, True)]
    assert sorted((x.doc_id, (x.text or "")[:2]) for x in near_dup.keep_first(df).collect()) == [(1, "a0"), (1, "b0"), (4, ""), (5, "c0")]


def test_substrings_under_one_id(spark):
    a, c = " ".join(f"a{i}" for i in range(100)), " ".join(f"c{i}" for i in range(100))
    df = spark.createDataFrame([(1, a), (5, a), (5, c), (5, a + " x"), (7, "y " + c)], "doc_id long, text string")
    got = sorted((x.doc_id, x.n_words, x.n_removed) for x in substring_dup.substring_dedup(df).collect())
    assert got == [(1, 100, 0), (5, 100, 0), (5, 100, 100), (5, 101, 100), (7, 101, 100)]
    assert sorted((x.doc_id, x.text) for x in substring_dup.cut_repeats(df).collect()) == [(1, a), (5, c), (5, "x"), (7, "y")]


def test_empty_documents_are_mixed_once_at_most(spark):
    rows = [(i, "" if i % 2 else "one two three", "en", "big" if i < 40 else "small", 0) for i in range(60)]
    got = Counter(r.doc_id for r in mixing.mix_rows(spark.createDataFrame(rows, ALL)).collect())
    assert max(got.values()) == 2 and all(n == 1 for i, n in got.items() if i % 2)


def brute_windows(rows, n=13):
    words = {i: WORD.findall(t or "") for i, t in rows}
    first: dict = {}
    for i, w in words.items():
        for k in range(len(w) - n + 1):
            s = tuple(w[k : k + n])
            first[s] = min(first.get(s, i), i)
    out = set()
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(n)}
        out.add((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("together", [2000, 2])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(substring_dup, "TOGETHER", together)
    r = random.Random(3)
    base = [r.choice("xyz") for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "a b c")]
    for i in range(3, 60):
        w = [r.choice("xyz") for _ in range(r.randint(10, 60))]
        if i % 2:
            k = r.randint(0, 40)
            w[5 : 5 + min(20, len(w) - 5)] = base[k : k + 20]
        rows.append((i, "  ".join(w)))
    got = {tuple(x) for x in substring_dup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_windows(rows)


def test_suffix_arrays():
    r = random.Random(1)
    for _ in range(300):
        s = [r.randint(1, r.choice([1, 2, 3, 200])) for _ in range(r.randint(0, 60))]
        assert suffix_array(np.array(s, dtype=np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute_bytes(texts, n):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("together", [1500, 1])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(suffix_dup, "TOGETHER", together)
    r = random.Random(4)
    base = "".join(r.choices("abcd é\n", k=3000))
    texts = [t for _, t, _ in documents(spark)[1][:60]] + ["De " * 700, "De " * 701, "ab" * 900 + "c", None, "", base, base]
    for i in range(30):
        k = r.randint(0, 2000)
        w = list(base[k : k + r.randint(300, 1000)])
        if i % 2:
            w[r.randrange(len(w))] = "X"
        texts.append("".join(w))
    df = spark.createDataFrame([(i if i % 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert sorted((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dup.suffix_dedup(df).collect()) == brute_bytes(texts, 400)
