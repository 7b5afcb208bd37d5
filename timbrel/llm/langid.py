"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties, then a temperature is
fitted on rows that training left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, remainder, settle, ship, table, tidy
from .ngrams import by_hash, counts, document_frequency, idf_of, sample_vectors, tfidf

ORDERS, BITS = (1, 2, 3), 13
#: Training texts of each language, at most, and of all (20 of each at least); every fifth of them calibrates.
PER_LANGUAGE, MOST = 500, 4000
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # classes x buckets
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (self.weights[:, at] @ w + self.bias) / self.temperature


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train_ftrl(
    rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, size: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02
) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate FTRL-proximal; a row is (class, buckets, weights). The last coordinate is the bias."""
    z, n = np.zeros((classes, size + 1)), np.zeros((classes, size + 1))

    def weights(zc: np.ndarray, nc: np.ndarray) -> np.ndarray:
        w = -(zc - np.sign(zc) * l1) / ((beta + np.sqrt(nc)) / alpha + l2)
        return np.where(np.abs(zc) <= l1, 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            y, at, x = rows[k]
            at, x = np.append(at, size), np.append(x, 1.0)
            zc, nc = z[:, at], n[:, at]
            w = weights(zc, nc)
            p = softmax(w @ x)
            p[y] -= 1.0
            g = p[:, None] * x[None, :]
            g2 = g * g
            z[:, at] = zc + g - (np.sqrt(nc + g2) - np.sqrt(nc)) / alpha * w
            n[:, at] = nc + g2
    w = weights(z, n)
    return w[:, :size].astype(np.float32), w[:, size]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The one of a fixed grid under which the left-out rows are likeliest."""
    best, least = 1.0, np.inf
    for t in np.geomspace(0.05, 10, 80):
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]))
        if loss < least - 1e-12:
            best, least = float(t), loss
    return best


def train(learn: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on rows (doc_id, text, lang): document frequencies over all, weights on a bounded sample of each language."""
    learn = learn.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    n = learn.select("lang").distinct().count()
    per_language = max(20, min(per_language, MOST // max(1, n)))
    ids = settle(by_hash(learn.select("doc_id", "lang").distinct(), "lang", per_language), "langid-sample")
    labels = sorted(r[0] for r in ids.select("lang").distinct().collect())
    if not labels:
        return None
    # of texts that share a doc_id and a language one is taken, so the sample stays bounded
    picked = learn.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy(F.col("doc_id").alias("key"), F.col("lang").alias("label")).agg(F.min("text").alias("text"))
    df, n = document_frequency(learn, ORDERS, BITS, True)
    idf = idf_of(df, n)
    code = {y: i for i, y in enumerate(labels)}
    rows = [(code[y], at, tfidf(at, c, idf).astype(np.float32)) for _, y, at, c in sample_vectors(picked, ORDERS, BITS, True)]
    discard(ids)
    left = rows[4::5]
    fit = [r for i, r in enumerate(rows) if i % 5 != 4]
    w, b = train_ftrl(fit, len(labels), 1 << BITS)
    model = Model(labels, w, b, idf, 1.0)
    if left:
        model.temperature = temperature(np.array([model.logits(at, x) for _, at, x in left]), np.array([y for y, _, _ in left]))
    return model


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def identify(docs: DataFrame, learn: DataFrame, held_out=None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``, by a model of ``learn`` (doc_id, text, lang).

    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing
    can be learned. Repeated rows count as often as they stand there; only the columns named
    are read, so others may bear any name. A very long text is read whole, in steps. The model's
    size is fixed by the number of buckets and languages, which bounds what is sent to executors.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(learn))
    held_out = F.lit(False) if held_out is None else held_out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = model.value
        for b in batches:
            pred, score = [], []
            for t in b.column(2):
                text = t.as_py()
                if m is None or not has_letter(text):
                    pred.append("und")
                    score.append(0.0)
                    continue
                at, n = counts(text, ORDERS, BITS, True)
                p = softmax(m.logits(at, tfidf(at, n, m.idf)))
                k = int(np.argmax(p))
                pred.append(m.labels[k])
                score.append(min(1.0, float(p[k])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text").mapInArrow(tidy(run), SCHEMA)


def _query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = remainder(F.col("doc_id"), 4) == 2
    return identify(docs, docs.filter(~out).select("doc_id", "text", "lang"), out)


QUERIES = {"op10_language_id": _query}
ORACLES: dict[str, str] = {}
