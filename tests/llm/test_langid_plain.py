"""Language identification step by step against plain versions: n-gram counts, TF-IDF, FTRL updates, temperature, scores."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from timbrel.llm import langid, ngrams

TEXTS = ["Über die Brücke", "the cat sat", "", "a", "ÉTÉ à la mer \U0001f600", "x" * 50]


def plain_ngrams(text, orders):
    t = " " + text.lower() + " "
    return Counter(t[i : i + n] for n in orders for i in range(len(t) - n + 1)) if text else Counter()


@pytest.mark.parametrize("text", TEXTS)
def test_counts_are_those_of_ngrams(text):
    at, n = ngrams.counts(text, (1, 2, 3), 24, True)
    assert sorted(n.tolist()) == sorted(plain_ngrams(text, (1, 2, 3)).values())
    assert len(set(at.tolist())) == len(at)


def test_long_texts_are_counted_in_steps_without_loss(monkeypatch):
    text = "the quick brown fox " * 40
    whole = ngrams.counts(text, (1, 2, 3), 16, True)
    monkeypatch.setattr(ngrams, "_STEP", 7)
    steps = ngrams.counts(text, (1, 2, 3), 16, True)
    assert whole[0].tolist() == steps[0].tolist() and whole[1].tolist() == steps[1].tolist()


def test_tfidf_by_hand(spark):
    bits, orders = 20, (1, 2)
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    df, n = ngrams.document_frequency(docs, orders, bits, True)
    idf = ngrams.idf_of(df, n)
    grams = [plain_ngrams(t, orders) for t in TEXTS]
    seen = Counter(g for c in grams for g in c)
    assert n == len(TEXTS) and sorted(df[df > 0].tolist()) == sorted(seen.values())
    at, c = ngrams.counts(TEXTS[1], orders, bits, True)
    weights = {g: (1 + math.log(k)) * (math.log((1 + n) / (1 + seen[g])) + 1) for g, k in grams[1].items()}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    assert np.allclose(sorted(ngrams.tfidf(at, c, idf)), sorted(w / norm for w in weights.values()), atol=1e-6)


def plain_ftrl(rows, classes, size, epochs, alpha, beta, l1, l2):
    """One coordinate after the other, in the order that the seed fixes."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            y, at, x = rows[r]
            x = {**dict(zip(at.tolist(), x.tolist())), size: 1.0}
            w = {(c, i): weight((c, i)) for c in range(classes) for i in x}
            logits = [sum(w[c, i] * v for i, v in x.items()) for c in range(classes)]
            top = max(logits)
            e = [math.exp(v - top) for v in logits]
            for c in range(classes):
                off = e[c] / sum(e) - (c == y)
                for i, v in x.items():
                    g = off * v
                    step = (math.sqrt(n[c, i] + g * g) - math.sqrt(n[c, i])) / alpha
                    z[c, i] += g - step * w[c, i]
                    n[c, i] += g * g
    return [[weight((c, i)) for i in range(size + 1)] for c in range(classes)]


def test_ftrl_equals_plain_updates():
    rnd = np.random.default_rng(3)
    rows = [(int(rnd.integers(3)), np.sort(rnd.choice(12, 4, replace=False)), rnd.random(4)) for _ in range(40)]
    w, b = langid.train_ftrl(rows, 3, 12, epochs=2, alpha=0.4, beta=1.0, l1=0.05, l2=0.03)
    want = np.array(plain_ftrl(rows, 3, 12, 2, 0.4, 1.0, 0.05, 0.03))
    assert np.allclose(w, want[:, :12], atol=1e-6) and np.allclose(b, want[:, 12])
    assert (w == 0).any() and (want[:, :12] == 0).sum() == (w == 0).sum()  # the l1 penalty leaves exact zeros


def test_the_temperature_is_the_likeliest_of_the_grid():
    rnd = np.random.default_rng(5)
    logits, y = rnd.normal(size=(60, 4)) * 3, rnd.integers(4, size=60)

    def loss(t):
        return -sum(math.log(math.exp(r[k] / t) / sum(math.exp(v / t) for v in r)) for r, k in zip(logits, y)) / len(y)

    grid = np.geomspace(0.05, 10, 80)
    assert langid.temperature(logits, y) == pytest.approx(min(grid, key=loss))


def test_predictions_follow_from_the_model(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr")] * 30)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(learn)
    asked = spark.createDataFrame([(1, "the dog"), (2, "die Katze"), (3, "le chien"), (4, "123"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(asked, learn).collect()}
    assert model.labels == ["de", "en", "fr"] and got[4] == got[5] == ("und", 0.0)
    for i, text in ((1, "the dog"), (2, "die Katze"), (3, "le chien")):
        at, n = ngrams.counts(text, langid.ORDERS, langid.BITS, True)
        x = ngrams.tfidf(at, n, model.idf)
        z = [float((model.weights[c, at].astype(float) * x).sum() + model.bias[c]) / model.temperature for c in range(3)]
        p = [math.exp(v) / sum(map(math.exp, z)) for v in z]
        assert got[i][0] == model.labels[int(np.argmax(p))] and got[i][1] == pytest.approx(max(p), abs=1e-4)
    assert [got[i][0] for i in (1, 2, 3)] == ["en", "de", "fr"]
