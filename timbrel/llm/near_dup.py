"""MinHash near-duplicates by a multi-index Hamming join.

Each set of word shingles has a signature of b-bit minima. Signatures are split into chunks; by
the pigeonhole principle two signatures within the distance threshold agree, in some chunk, but
for a few symbols. Every way to leave out that many symbols gives a key, so all pairs under the
threshold share a key. Candidates are confirmed on full sets; components come from confirmed links.

Pairs are spelled out only for keys with few members. A larger key ties its members to one of
them, so that candidates fall into clusters; a cluster's full sets are compared in blocks, all
against all, by products of incidence matrices, and a block returns no more than a forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, ship, table, tidy, unused
from .components import connected_components
from .shingles import shingle_set

#: Words of a shingle; least similarity in per cent.
SHINGLE, SIMILARITY = 5, 75
#: Symbols of a signature, bits of a symbol.
SYMBOLS, BITS = 48, 16
#: Two texts of the least similarity differ in a quarter of the symbols, 12 on average; in more
#: than this with a probability of about 4e-6.
DISTANCE = 26
CHUNKS = (6, 5, 5, 6, 5, 5, 6, 5, 5)
#: Members up to which a key's pairs are spelled out; texts of a block, and shingles that its texts have together, on average.
FEW, BLOCK, HEAVY = 4, 512, 1 << 19
#: Columns of an incidence matrix that are multiplied at a time.
_COLUMNS = 4096


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_000)
    a = r.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], r.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)[:, None]


def signature(s: np.ndarray) -> np.ndarray:
    """The b-bit minima of a non-empty set."""
    a, b = _permutations()
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 1 << 14):
        np.minimum(low, (s[None, at : at + (1 << 14)] * a + b).min(axis=1), out=low)
    low ^= low >> np.uint64(32)
    low ^= low >> np.uint64(16)
    return (low & np.uint64((1 << BITS) - 1)).astype(np.uint16)


@lru_cache(maxsize=1)
def key_places() -> list[tuple[int, ...]]:
    """Places of the signature that make up each key."""
    wrong = DISTANCE // len(CHUNKS)
    out, at = [], 0
    for size in CHUNKS:
        out += [tuple(at + p for p in c) for c in combinations(range(size), size - wrong)]
        at += size
    return out


def keys_of(sigs: np.ndarray) -> np.ndarray:
    """64-bit keys of each signature (rows), one for each entry of key_places()."""
    from .shingles import mix

    out = np.empty((len(sigs), len(key_places())), dtype=np.uint64)
    s = sigs.astype(np.uint64)
    for k, places in enumerate(key_places()):
        v = np.zeros(len(s), dtype=np.uint64)
        for p in places:
            v = (v << np.uint64(16)) | s[:, p]
        out[:, k] = mix(v + np.uint64(k * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)))
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            c = b.slice(at, 512)
            n, fp, sig = [], [], []
            for t in c.column(2).cast(pa.binary()):
                s = shingle_set(t.as_py(), SHINGLE)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "th", "n", "fp", "sig"])


def _explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            c = b.slice(at, 1024)
            if c.num_rows:
                k = keys_of(np.stack([np.frombuffer(x.as_py(), dtype=np.uint16) for x in c.column(1)]))
                ids = np.repeat(c.column(0).to_numpy(zero_copy_only=False), k.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), pa.array(ids)], ["key", "id"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 64):
            c = b.slice(at, 64)
            s = [shingle_set(t.as_py(), SHINGLE).view(np.int64) for t in c.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([c.column(0), pa.array(s, pa.list_(pa.int64())), c.column(2), c.column(3)], ["id", "set", "cluster", "blocks"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sa, sb) within the signature distance."""
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS) for i in (2, 3))
            ok = pa.array((x != y).sum(axis=1) <= DISTANCE)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])


def block_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between texts; where two sides meet, only links across count."""
    m = len(ids)
    size = np.array([len(x) for x in sets], dtype=np.int64)
    words, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # what only one text has adds to no intersection
    row = np.repeat(np.arange(m), size)
    keep = times[column] > 1
    row, column = row[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((m, m), dtype=np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, (low, low + _COLUMNS))
        x = np.zeros((m, _COLUMNS), dtype=np.float32)
        x[row[a:b], column[a:b] - low] = 1.0
        both += x @ x.T  # counts stay exact below 2^24
    near = 100 * both.astype(np.int64) >= SIMILARITY * (size[:, None] + size[None, :] - both.astype(np.int64))
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, True)
    label = np.arange(m)
    while True:
        low = np.where(near, label[None, :], m).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    child = np.flatnonzero(label != np.arange(m))
    return ids[child], ids[label[child]]


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group of rows (cluster, low, high, block, id, set), which come group by group."""
    held: list[tuple[int, int, np.ndarray]] = []
    group = None

    def links() -> Iterator[pa.RecordBatch]:
        # texts that are repeated under one id count once
        rows = list({x[0]: x for x in held}.values())
        if len(rows) > 1:
            a, b = block_links(np.array([x[0] for x in rows], dtype=np.int64), [x[2] for x in rows], np.array([x[1] != group[1] for x in rows]))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(5)]
        sets = batch.column(5)
        for k, (cluster, low, high, block, i) in enumerate(zip(*cols, strict=True)):
            if (cluster, low, high) != group:
                yield from links()
                held.clear()
                group = (cluster, low, high)
            held.append((i, block, np.asarray(sets[k].values).copy()))
    yield from links()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept.

    Documents with equal shingle sets are one class, searched once. Null and empty texts have no
    shingle and stand alone; so do rows with a null doc_id (component null, kept). Rows that
    share a doc_id are judged each by its own text. An empty table gives none. Only doc_id and
    text are read, so other columns may bear any name.
    """
    return _judged(docs).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame) -> DataFrame:
    """The same with ``th``, a hash of the row's text."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    all_ = settle(docs.mapInArrow(tidy(_describe), "doc_id long, th long, n long, fp binary, sig binary"), "near-signatures")
    full = all_.filter("n > 0 AND doc_id IS NOT NULL")
    reps = full.groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("m"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # a number of its own for each class: several may have the same smallest doc_id
    reps = reps.select("fp", F.monotonically_increasing_id().alias("id"), F.col("m.doc_id").alias("doc"), F.col("m.th").alias("th"), "n", "sig")
    reps = settle(reps, "near-classes")
    comp = _components(docs, reps)
    least = reps.join(comp, "id").groupBy("comp").agg(F.min("doc").alias("least"))
    joined = comp.join(least, "comp").select(F.col("id").alias("_id"), "least")
    classes = reps.join(joined, F.col("id") == F.col("_id"), "left").select(F.col("fp").alias("_fp"), F.coalesce("least", "doc").alias("component_id"))
    out = all_.select("doc_id", "th", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("fp")).alias("fp"))
    out = out.join(classes, F.col("fp") == F.col("_fp"), "left").select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _components(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, comp) of those classes that have a link; ``reps``: id, doc and th of the text that stands for it, n, sig."""
    keyed = reps.select("id", "sig").mapInArrow(tidy(_explode_keys), "key long, id long")
    shared = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key")
    members = settle(keyed.join(shared, "key"), "near-keys")
    order = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("id"))
    keys = settle(members.groupBy("key").agg(F.count("*").alias("n"), F.min(order).alias("c")).select("key", "n", F.col("c.id").alias("c")), "near-centres")
    few = members.join(keys.filter(F.col("n") <= FEW).select("key"), "key")
    pairs = few.select("key", F.col("id").alias("a")).join(few.select("key", F.col("id").alias("b")), "key").filter("a < b").select("a", "b").distinct()
    r = reps.select("id", "n", "sig")
    pairs = pairs.join(r.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
    pairs = pairs.join(r.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    pairs = pairs.filter(100 * F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb")).select("a", "b", "sa", "sb").mapInArrow(tidy(_near), "a long, b long")
    many = members.join(keys.filter(F.col("n") > FEW).select("key", "c"), "key").select(F.col("id").alias("a"), F.col("c").alias("b")).filter("a <> b").distinct()
    clusters = settle(connected_components(pairs.unionByName(many)), "near-clusters")
    discard(members, keys)
    clusters = clusters.withColumnRenamed("comp", "cluster")
    inside = reps.select("id", F.col("doc").alias("_doc"), F.col("th").alias("_th"), "n").join(clusters, "id")
    blocks = inside.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / HEAVY)).alias("blocks"))
    some = inside.join(blocks, "cluster").select("id", "_doc", "_th", "cluster", "blocks")
    texts = docs.join(some, (docs["doc_id"] == some["_doc"]) & (docs["th"] == some["_th"]))
    sets = settle(texts.select("id", "text", "cluster", "blocks").mapInArrow(tidy(_sets), "id long, set array<long>, cluster long, blocks long"), "near-sets")
    block = F.pmod(F.xxhash64(F.lit(1), "id"), "blocks")
    dealt = sets.select("cluster", block.alias("block"), "id", "set", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "set")
    dealt = dealt.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "id")
    links = dealt.mapInArrow(tidy(_confirm), "a long, b long")
    comp = settle(connected_components(links), "near-components")
    discard(sets)
    return comp


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are their component's first document, with all their columns.

    Rows that share a doc_id are judged each by its own text; of rows that are alike in doc_id
    and text, all stay.
    """
    doc, text = unused(docs.columns, "gone_doc", "gone_text")
    gone = _judged(docs).filter(~F.col("kept")).select(F.col("doc_id").alias(doc), F.col("th").alias(text)).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(text)), "left_anti")


def _query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM t
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (
  WITH RECURSIVE c(id, comp) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT e.b, c.comp FROM c JOIN e ON e.a = c.id WHERE c.comp < e.b
  ) SELECT id, min(comp) AS comp FROM c GROUP BY id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.comp AS component_id, d.doc_id = r.comp AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id
"""

QUERIES = {"op8_near_duplicates": _query}
ORACLES = {"op8_near_duplicates": SQL}
