"""Hashed character n-grams of whole texts, as TF-IDF vectors, and their corpus counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, ship, sized, tidy

#: Odd multipliers; one for each place of an n-gram, and one to mix the sum.
_MUL = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)
#: Characters hashed at a time, so that memory doesn't follow a text's length.
_STEP = 1 << 20
#: How many times the wanted number of rows of a label are looked at when a sample is drawn.
SPARE = 4


def counts(text: str, orders: tuple[int, ...], bits: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and how many n-grams of the whole text (a space before and after it) fall into them."""
    size = 1 << bits
    total = np.zeros(size, dtype=np.int64)
    if text:
        if lower:
            text = text.lower()
        cp = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        most = max(orders)
        for at in range(0, len(cp), _STEP):
            part = cp[at : at + _STEP + most - 1]
            for n in orders:
                m = min(len(part) - n + 1, _STEP)
                if m <= 0:
                    continue
                h = np.full(m, n * 0x3C6EF35F & 0xFFFFFFFF, dtype=np.uint32)
                for k in range(n):
                    h ^= part[k : k + m] * _MUL[k]
                    h *= np.uint32(0x9E3779B1)
                    h ^= h >> np.uint32(15)
                total += np.bincount(h >> np.uint32(32 - bits), minlength=size)
    at = np.flatnonzero(total)
    return at, total[at]


def tfidf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of the buckets: log term frequency by idf, of unit length."""
    w = (1.0 + np.log(n)) * idf[at]
    norm = np.sqrt(np.sum(w * w))
    return w / norm if norm else w


def document_frequency(docs: DataFrame, orders: tuple[int, ...], bits: int, lower: bool, counter=counts) -> tuple[np.ndarray, int]:
    """In how many texts of ``docs`` (all of them) each bucket occurs, and how many texts there are.

    Each partition adds up its own; what reaches the driver has the size of the model.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros((1 << bits) + 1, dtype=np.int64), 0
        for b in batches:
            for t in b.column(0):
                df[counter(t.as_py() or "", orders, bits, lower)[0]] += 1
                n += 1
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["bucket", "n"])

    out = np.zeros((1 << bits) + 1, dtype=np.int64)
    for r in docs.select("text").mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[r[0]] = r[1]
    return out[:-1], int(out[-1])


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return (np.log((1.0 + n) / (1.0 + df)) + 1.0).astype(np.float32)


def sample_vectors(sample: DataFrame, orders: tuple[int, ...], bits: int, lower: bool, counter=counts) -> list[tuple]:
    """(key, label, buckets, counts) of each row of ``sample`` (key, label, text), which the caller bounds; ordered by key."""
    ship(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, labels = b.column(0), b.column(1)
            for i, t in enumerate(b.column(2)):
                at, n = counter(t.as_py() or "", orders, bits, lower)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, 1), labels.slice(i, 1), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([n], pa.list_(pa.int64()))],
                    ["key", "label", "at", "n"],
                )

    kind = dict(sample.dtypes)
    got = sample.select("key", "label", "text").mapInArrow(tidy(run), f"key long, label {kind['label']}, at array<int>, n array<long>")
    rows = got.toPandas()
    rows = rows.sort_values("key", kind="stable")
    return [(k, y, np.asarray(a, dtype=np.int32), np.asarray(n)) for k, y, a, n in rows.itertuples(index=False, name=None)]


def by_hash(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` rows (doc_id, label) of each label, the same on every run: the smallest hashes.

    Hashes above a share that leaves several times ``per_label`` of a label fall out first, so
    its window stays small however many rows the label has.
    """
    h = F.xxhash64("doc_id")
    sizes = settle(rows.groupBy(F.col(label).alias("_label")).count(), "label-sizes")
    some = rows.join(sized(sizes), F.col(label) == F.col("_label"))
    some = some.filter(F.pmod(h, F.lit(1 << 40)) * F.col("count").cast("double") < float(SPARE * per_label * (1 << 40))).drop("_label", "count")
    w = Window.partitionBy(label).orderBy(F.pmod(h, F.lit(1 << 40)), "doc_id")
    return some.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_label).drop("_r")
