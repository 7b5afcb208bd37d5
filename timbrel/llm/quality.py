"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Labelled texts become latent-semantic vectors (hashed character n-grams of the text, repeated
words marked; TF-IDF; truncated singular value decomposition). They are broadcast; every document's cosine to each of them is
computed in blocks, exactly, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import discard, remainder, settle, ship, table, tidy
from .ngrams import by_hash, document_frequency, idf_of, sample_vectors

ORDERS, BITS = (2, 3), 12
#: Labelled texts of each class, at most; dimensions; voters; power of a similarity in the vote. Chosen
#: by fourfold cross-validation among the rows that may be learned from.
PER_CLASS, DIMENSIONS, NEIGHBOURS, POWER = 1200, 64, 5, 16
#: Score from which a document is kept.
THRESHOLD = 0.3
#: Documents whose cosines are computed at once.
BLOCK = 256
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: What stands for a word that is the same as the one before it.
REPEAT = "\u21bb"


def counts(text: str, orders: tuple[int, ...], bits: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts of the text, in which a word that repeats the one before it is read as a mark."""
    words = text.split(" ")
    if len(words) > 1:
        text = " ".join([words[0], *[REPEAT if x == y and x else x for x, y in zip(words[1:], words, strict=False)]])
    return ngrams.counts(text, orders, bits, lower)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # buckets x dimensions
    vectors: np.ndarray  # labelled x dimensions, of unit length
    labels: np.ndarray


def embed(rows: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, axes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), axes.shape[1]), dtype=np.float32)
    for i, (at, n) in enumerate(rows):
        if len(at):
            out[i] = ngrams.tfidf(at, n, idf).astype(np.float32) @ axes[at]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def latent_axes(rows: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, dimensions: int) -> np.ndarray:
    """Right singular vectors of the rows' TF-IDF matrix, by a randomised range finder."""
    a = np.zeros((len(rows), len(idf)), dtype=np.float32)
    for i, (at, n) in enumerate(rows):
        a[i, at] = ngrams.tfidf(at, n, idf)
    q = np.random.default_rng(11).standard_normal((len(idf), min(dimensions + 8, max(1, len(rows))))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(a.T @ (a @ q))
    _, _, v = np.linalg.svd(a @ q, full_matrices=False)
    return np.ascontiguousarray((q @ v.T)[:, :dimensions]).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """labels: doc_id, quality. Counts cover all of ``docs``; voters are a bounded sample of each class."""
    docs = docs.select("doc_id", "text")
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("q"))
    known = known.select("doc_id", F.when(F.col("q") >= 0.5, 1).otherwise(0).alias("label"))
    here = docs.select("doc_id").join(known, "doc_id").distinct()
    ids = settle(by_hash(here, "label", per_class), "quality-sample")
    picked = docs.join(F.broadcast(ids), "doc_id").groupBy(F.col("doc_id").alias("key"), "label").agg(F.min("text").alias("text"))
    got = sample_vectors(picked, ORDERS, BITS, False, counts)
    discard(ids)
    if not got:
        return None
    df, n = document_frequency(docs, ORDERS, BITS, False, counts)
    idf = idf_of(df, n)
    rows = [(at, c) for _, _, at, c in got]
    axes = latent_axes(rows, idf, DIMENSIONS)
    return Model(idf, axes, embed(rows, idf, axes), np.array([y for _, y, _, _ in got], dtype=np.float64))


def vote(x: np.ndarray, m: Model, k: int = NEIGHBOURS) -> np.ndarray:
    """Share of label 1 among the ``k`` nearest, by similarity; without a neighbour, the labels' mean."""
    sim = x @ m.vectors.T
    k = min(k, sim.shape[1])
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(sim, near, axis=1).astype(np.float64), 0.0) ** POWER
    total = w.sum(axis=1)
    yes = (w * m.labels[near]).sum(axis=1)
    return np.clip(np.divide(yes, total, out=np.full(len(x), m.labels.mean()), where=total > 0), 0.0, 1.0)


def _scorer(model) -> object:
    def score(texts: list[str | None]) -> np.ndarray:
        m: Model | None = model.value
        out = np.full(len(texts), 0.5)
        if m is not None:
            for at in range(0, len(texts), BLOCK):
                rows = [counts(t or "", ORDERS, BITS, False) for t in texts[at : at + BLOCK]]
                out[at : at + BLOCK] = vote(embed(rows, m.idf, m.axes), m)
        return out

    return score


def score_documents(docs: DataFrame, labels: DataFrame, held_out=None) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; ``labels`` are only those that may be learned from.

    A null or empty text has no neighbour: its score is the mean label of the voters. Without
    any labelled text all scores are 0.5. A very long text is read whole, in steps; repeated
    rows are scored each. Of texts that share a labelled doc_id one votes. Only the columns named
    are read, so others may bear any name. Broadcast is the model alone, of fixed size.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(docs, labels))
    score = _scorer(model)
    held_out = F.lit(False) if held_out is None else held_out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                c = b.slice(at, BLOCK)
                s = score(c.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [c.column(0), c.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text").mapInArrow(tidy(run), SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(docs, labels))
    score = _scorer(model)

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                c = b.slice(k, BLOCK)
                yield c.filter(pa.array(score(c.column(at).to_pylist()) >= THRESHOLD))

    return docs.mapInArrow(tidy(run), docs.schema)


def learnable(labels: DataFrame) -> DataFrame:
    return labels.filter(remainder(F.col("doc_id"), 5) != 0).select("doc_id", "quality")


def _query(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"), learnable(table(spark, sf_dir, "labels")), remainder(F.col("doc_id"), 5) == 0)


QUERIES = {"op4_quality_classifier": _query}
ORACLES: dict[str, str] = {}
