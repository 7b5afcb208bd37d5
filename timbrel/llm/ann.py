"""Nearest neighbours along shifted space-filling curves.

Vectors are projected to a few dimensions, several times, each time shifted by another random
offset, and put in the order of a Hilbert curve by range partitioning. Each query meets the
window of neighbouring keys on every curve; the best of each window are merged and reranked by
exact inner products. Inner product becomes distance by one more dimension that brings all
vectors to the largest norm.

How many curves and how wide a window a wanted recall takes is measured on a bounded sample of
queries, which are compared with all rows: where vectors lie in clusters, a few hundred rows do;
where all directions are alike, nothing short of most rows does, whatever the method.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, settle, ship, table, tidy
from .hilbert import hilbert_key

#: Curves that there are to choose from; dimensions of a projection and bits of each.
CURVES, DIMENSIONS, BITS = 16, 6, 10
#: Share of the true neighbours that windows must hold, and queries on which it is measured, at most.
RECALL, SAMPLE = 0.95, 256
#: Least rows on either side of a query; most neighbouring places whose queries share a group.
LEAST, PART = 128, 16_384
#: Candidates compared at once, and queries at once.
_CANDIDATES, _QUERIES = 2048, 1024
#: Every so many rows is a query; neighbours of each.
EVERY, K = 20, 20


def _projection(curve: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng([17, curve])
    q, _ = np.linalg.qr(r.standard_normal((dims, min(DIMENSIONS, dims))))
    return q, r.uniform(-0.05, 0.05, q.shape[1])


def curve_keys(x: np.ndarray, extra: np.ndarray, curve: int, norm: float) -> np.ndarray:
    """Hilbert keys of vectors with their further component, scaled to the largest norm."""
    q, shift = _projection(curve, x.shape[1] + 1)
    # projections of points on a sphere spread by 1 / sqrt(dimensions)
    y = (np.column_stack((x, extra)) / norm) @ q * np.sqrt(x.shape[1] + 1) / 4 + shift
    return hilbert_key(np.clip((y + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def _score(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products row by row; the same two vectors give the same number wherever they meet."""
    return (q * c).sum(axis=1)


class Best:
    """The ``k`` best candidates so far of each of some queries."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k = q, k
        self.ids = np.full((len(q), 0), -1, dtype=np.int64)
        self.scores = np.zeros((len(q), 0))

    def add(self, cid: np.ndarray, c: np.ndarray) -> None:
        k = min(self.k, len(c))
        ids, scores = [], []
        for at in range(0, len(self.q), _QUERIES):
            q = self.q[at : at + _QUERIES]
            top = np.argpartition(-(q @ c.T), k - 1, axis=1)[:, :k]
            scores.append(_score(np.repeat(q, k, axis=0), c[top.ravel()]).reshape(-1, k))
            ids.append(cid[top])
        ids, scores = (np.concatenate((old, np.concatenate(new)), axis=1) for old, new in ((self.ids, ids), (self.scores, scores)))
        if ids.shape[1] > self.k:
            top = np.argpartition(-scores, self.k - 1, axis=1)[:, : self.k]
            ids, scores = np.take_along_axis(ids, top, axis=1), np.take_along_axis(scores, top, axis=1)
        self.ids, self.scores = ids, scores

    def rows(self, qid: np.ndarray) -> pa.RecordBatch:
        n = self.ids.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, n)), pa.array(self.ids.ravel()), pa.array(self.scores.ravel())], ["q", "c", "score"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def _meet(k: int):
    """The best of each group's candidates for each of its queries. Rows (curve, part, kind, c, v) come group by group, queries first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, qid, q, best = None, [], [], None
        for b in batches:
            where = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)])
            edges = np.concatenate(([0], np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1, [b.num_rows])) if b.num_rows else []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                curve, part, kind = where[:, low].tolist()
                if (curve, part) != group:
                    if best is not None:
                        yield best.rows(np.concatenate(qid))
                    group, qid, q, best = (curve, part), [], [], None
                for at in range(low, high, _CANDIDATES):
                    c = b.slice(at, min(_CANDIDATES, high - at))
                    ids, v = c.column(3).to_numpy(), _matrix(c.column(4))
                    if kind == 0:
                        qid.append(ids)
                        q.append(v)
                    elif q:
                        best = best or Best(np.concatenate(q), k)
                        best.add(ids, v)
        if best is not None:
            yield best.rows(np.concatenate(qid))

    return run


def _scan(qid: np.ndarray, q: np.ndarray, k: int):
    """The best of each partition's rows (c, v) for each of a bounded sample of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(q, k)
        for b in batches:
            for at in range(0, b.num_rows, _CANDIDATES):
                c = b.slice(at, _CANDIDATES)
                best.add(c.column(0).to_numpy(), _matrix(c.column(1)))
        yield best.rows(qid)

    return run


def group_size(side: int) -> int:
    """Places whose queries share a group: about as many as a window has, so that candidates go to few groups; bounded."""
    return min(PART, max(512, side))


def cheapest(rank: np.ndarray, near: np.ndarray, size: int, recall: float) -> tuple[int, int]:
    """How many curves, and rows on either side, hold a share ``recall`` of near neighbours at the least cost.

    ``rank``: (curve, query) places of queries; ``near``: (curve, query, neighbour) places of
    their true neighbours, -1 for none; ``size``: places of a curve.
    """
    far = np.minimum.accumulate(np.abs(near - rank[:, :, None]), axis=0)
    there = near[0] >= 0
    choices = []
    for curves in range(1, len(far) + 1):
        d = np.sort(far[curves - 1][there])
        side = int(d[min(len(d) - 1, int(np.ceil(recall * len(d))))]) if len(d) else 0
        side = max(LEAST, side)
        choices.append((curves * min(size, 2 * side + group_size(side)), curves, side))
    _, curves, side = min(choices)
    return curves, side


def nearest(vectors: DataFrame, is_query, k: int = K, recall: float = RECALL, curves: int = CURVES, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row for which ``is_query`` holds.

    Vectors that are null, zero, or hold a null or a component that isn't finite take no part,
    nor do those whose length isn't the commonest (ties: the shorter), nor rows without an id.
    Equal vectors are searched once, and stand for as many of their ids, the smallest, as a
    query can need; so ties and large groups of copies cost nothing. Ids should be unique; of
    rows that share one, each vector may be reported. Other columns aren't read. An empty table
    gives no row. Of ``curves`` as many are used, with such windows, as hold a share ``recall`` of
    the true neighbours of a sample of queries at the least cost.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("v")
    df = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = df.filter(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0.0))
    lengths = df.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], empty)
    df = df.filter(F.size("v") == lengths["n"])

    w = Window.partitionBy("v").orderBy("id")
    low = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1).groupBy("v").agg(F.min("id").alias("c"), F.sort_array(F.collect_set("id")).alias("ids"))
    asking = df.filter("asks").select("v").distinct().select(F.col("v").alias("_v"))
    classes = low.join(asking, F.col("v") == F.col("_v"), "left").select("c", "v", "ids", F.col("_v").isNotNull().alias("asks"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))
    classes = settle(classes, "ann-classes")
    top = classes.agg(F.max("norm")).first()[0]
    if top is None:
        return spark.createDataFrame([], empty)

    # vectors as bytes: a row is as wide as its numbers
    packed = classes.select("c", "asks", "v").mapInArrow(tidy(_packed), "c long, asks boolean, v binary")
    packed = settle(packed, "ann-vectors")
    points = packed.mapInArrow(tidy(_keyed(curves, float(top))), "curve int, key long, c long, kind int")
    points = ranked(points, [F.col("curve"), F.col("key"), F.col("c"), F.col("kind")], "ann-curves")
    # every curve has the same number of places
    size = points.filter("curve = 0").count()
    points = points.select("curve", "c", "kind", (F.col("rank") - F.col("curve") * F.lit(size)).alias("place"))
    curves, side = _fitted(packed, points, curves, size, k, recall)

    group = group_size(side)
    part = F.floor(F.col("place") / group)
    near = points.filter(F.col("curve") < curves)
    asks = near.filter("kind = 0").select("curve", part.alias("part"), "kind", "c")
    # a candidate goes to each part whose queries' windows can reach it
    first, last = (F.floor((F.col("place") + d) / group) for d in (-side, side))
    parts = F.sequence(F.greatest(F.lit(0), first), F.least(F.lit((size - 1) // group), last))
    cands = near.filter("kind = 1").select("curve", F.explode(parts).alias("part"), "kind", "c")
    rows = asks.unionByName(cands).join(packed.select("c", "v"), "c").select("curve", "part", "kind", "c", "v")
    rows = rows.repartition("curve", "part").sortWithinPartitions("curve", "part", "kind")
    found = rows.mapInArrow(tidy(_meet(k + 1)), "q long, c long, score double")
    own = classes.filter("asks").select(F.col("c").alias("q"), "c", F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda a, x: a + x).alias("score"))
    found = found.unionByName(own).groupBy("q", "c").agg(F.max("score").alias("score"))
    by = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    found = found.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k + 1).drop("_r")
    wide = found.join(classes.select("c", "ids"), "c").select("q", F.explode("ids").alias("vec_id"), "score")
    by = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    wide = wide.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k + 1).groupBy("q").agg(F.collect_list(F.struct("_r", "vec_id", "score")).alias("near"))
    ids = df.filter("asks").select(F.col("id").alias("query_id"), F.col("v").alias("_v")).distinct()
    ids = ids.join(classes.filter("asks").select("v", F.col("c").alias("q")), F.col("_v") == F.col("v")).select("query_id", "q")
    mine = ids.join(wide, "q").select("query_id", F.sort_array(F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))).alias("near"))
    out = mine.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x = np.asarray(b.column(2).flatten()).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["c", "asks", "v"])


def _keyed(curves: int, top: float):
    """Rows (curve, key, c, kind) of each class: as a query (kind 0) if it asks, and as a candidate (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                s = b.slice(at, 2048)
                x = _matrix(s.column(2))
                asks = np.flatnonzero(s.column(1).to_numpy(zero_copy_only=False).astype(bool))
                ids = s.column(0).to_numpy()
                norm = np.linalg.norm(x, axis=1)
                more = np.sqrt(np.maximum(top * top - norm * norm, 0.0))
                for curve in range(curves):
                    data = curve_keys(x, more, curve, top)
                    query = curve_keys(x[asks] * (top / norm[asks])[:, None], np.zeros(len(asks)), curve, top)
                    kind = np.repeat(np.array([1, 0], np.int32), (len(x), len(asks)))
                    rows = np.concatenate((np.arange(len(x)), asks))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), curve, np.int32)), pa.array(np.concatenate((data, query))), pa.array(ids[rows]), pa.array(kind)], ["curve", "key", "c", "kind"])

    return run


def _fitted(packed: DataFrame, points: DataFrame, curves: int, size: int, k: int, recall: float) -> tuple[int, int]:
    """Curves and window side that hold ``recall`` of the neighbours of at most SAMPLE queries, compared with all rows."""
    sample = packed.filter("asks").select("c", "v").orderBy(F.xxhash64("c"), "c").limit(SAMPLE).collect()
    if not sample:
        return 1, LEAST
    qid = np.array([r["c"] for r in sample], dtype=np.int64)
    q = np.stack([np.frombuffer(r["v"], dtype=np.float64) for r in sample])
    best = packed.select("c", "v").mapInArrow(tidy(_scan(qid, q, k + 1)), "q long, c long, score double").filter("q <> c")
    by = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    best = best.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k)
    pairs = [(r["q"], r["c"], r["_r"] - 1) for r in best.select("q", "c", "_r").collect()]
    of = {c: i for i, c in enumerate(qid.tolist())}
    wanted = packed.sparkSession.createDataFrame([(c,) for c in {c for _, c, _ in pairs} | set(of)], "c long")
    places = {(r["curve"], r["c"], r["kind"]): r["place"] for r in points.join(F.broadcast(wanted), "c").collect()}
    rank = np.array([[places[v, c, 0] for c in qid.tolist()] for v in range(curves)])
    near = np.full((curves, len(qid), k), -1, dtype=np.int64)
    for a, c, r in pairs:
        near[:, of[a], r] = [places[v, c, 1] for v in range(curves)]
    return cheapest(rank, near, size, recall)


def _query(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op3_nearest_neighbours": _query}
ORACLES: dict[str, str] = {}
