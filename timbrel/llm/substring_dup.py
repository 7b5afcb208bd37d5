"""Substring de-duplication with FM-indexes.

Equal windows of words have the same minimiser (the least hash among their short runs of words),
so windows meet by it. A minimiser with the windows around it is a context; contexts that occur
in full in an earlier document settle all their windows at once. Only contexts whose minimiser
occurs in several documents amid different words remain. They are dealt to shards; each shard
builds a compressed FM-index of its contexts and streams all of them through it: backward search
gives matching statistics, and windows that match in full learn the earliest document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, repeated_ids, settle, ship, table, tidy, unused, with_version
from .fm_index import FMIndex
from .shingles import mix, windows, word_hashes

#: Words of a window, and of the runs among which its minimiser is chosen.
WINDOW, RUN = 13, 5
#: Runs in a window; a minimiser governs at most as many windows.
SPAN = WINDOW - RUN + 1
#: Contexts of one minimiser that stay together; larger groups are dealt by window. Contexts of a shard.
TOGETHER, SHARD = 2000, 30_000


def anchors(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the word hashes of texts, one after another: key, context hash, text, first window in it and number of windows of each minimiser."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return e.view(np.uint64), e.view(np.uint64), e, e, e
    g = windows(h, RUN)
    # the leftmost of the least: windows double in length, then two overlap
    low, at, length = g, np.arange(len(g), dtype=np.int32), 1
    while length < SPAN:
        step = min(length, SPAN - length)
        m = len(low) - step
        left, right = low[:m], low[step:]
        at = np.where(right < left, at[step:], at[:m])
        low = np.minimum(left, right)
        length += step
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)[:n]
    inside = np.flatnonzero(np.arange(n) + WINDOW <= ends[text])  # windows of one text
    at, low, text = at[inside], low[inside], text[inside]
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(inside) else inside
    first, many = inside[new], np.diff(np.append(new, len(inside)))
    # hash of the words [first, first + many + WINDOW - 1) by prefix sums of a polynomial
    power = [p[: len(h)] for p in _powers(len(h))]
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[1], dtype=np.uint64)))
    end = first + many + WINDOW - 1
    ctx = mix((run[end] - run[first]) * power[0][first] + many.astype(np.uint64) * np.uint64(31) + (at[new] - first).astype(np.uint64))
    return low[new], ctx, text[new], first - (ends - sizes)[text[new]], many  # low is the minimiser's own hash


#: Powers of the hash's base and of its inverse that a worker keeps; words of texts that are hashed together.
KEPT, TOGETHER_WORDS = 1 << 15, 1 << 14
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers_to(n: int) -> list[np.ndarray]:
    out = []
    for b in (_INVERSE, _BASE):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out


@lru_cache(maxsize=1)
def _kept() -> list[np.ndarray]:
    return _powers_to(KEPT)


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the inverse base and of the base (mod 2^64); those of a very long text aren't kept."""
    return _kept() if n <= KEPT else _powers_to(n)


def _word_blocks(texts: list[bytes | None]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Places of some neighbouring texts that have a window, their numbers of words, and their words."""
    at: list[int] = []
    sizes: list[int] = []
    words: list[bytes] = []
    for i, t in enumerate(texts):
        w = t.split() if t else []
        if len(w) < WINDOW:
            continue
        if words and len(words) + len(w) > TOGETHER_WORDS:
            yield at, sizes, words
            at, sizes, words = [], [], []
        at.append(i)
        sizes.append(len(w))
        words += w
    if words:
        yield at, sizes, words


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in range(0, b.num_rows, 256):
            c = b.slice(row, 256)
            doc, version = c.column(0).to_numpy(), c.column(1).to_numpy()
            for at, sizes, words in _word_blocks(c.column(2).cast(pa.binary()).to_pylist()):
                key, ctx, text, first, many = anchors(word_hashes(words), np.array(sizes))
                own = np.array(at)[text]
                cols = (key.view(np.int64), ctx.view(np.int64), doc[own], version[own], first.astype(np.int32), many.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "ctx", "doc", "version", "first", "many"])


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        for at in range(0, b.num_rows, 256):
            c = b.slice(at, 256)
            yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array([z.compress(t or b"") for t in c.column(2).cast(pa.binary()).to_pylist()], pa.binary())], ["doc_id", "version", "z"])


def _unsqueezed(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z) if z else b""


def _listed(column: pa.ListArray, *names: str) -> tuple[list[int], list[np.ndarray]]:
    """Borders of each row's part of the named fields, and these fields, of a list of structs; a null list has an empty part."""
    return column.offsets.to_pylist(), [column.values.field(n).to_numpy(zero_copy_only=False) for n in names]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(route, key, ctx, doc, offset, words): one row for a context, or one for each window of a large group."""
    for batch in batches:
        for row in range(0, batch.num_rows, 64):
            b = batch.slice(row, 64)
            docs = b.column(0).to_numpy()
            borders, (keys, ctxs, firsts, counts, large) = _listed(b.column(2), "key", "ctx", "first", "many", "large")
            route, which, own, offset, texts = [], [], [], [], []
            for i, z in enumerate(b.column(1).to_pylist()):
                words = _unsqueezed(z).split()
                low, high = borders[i], borders[i + 1]
                for j, key, first, many, apart in zip(range(low, high), keys[low:high].tolist(), firsts[low:high].tolist(), counts[low:high].tolist(), large[low:high].tolist(), strict=True):
                    if apart:
                        route += windows(word_hashes(words[first : first + many + WINDOW - 1]), WINDOW).view(np.int64).tolist()
                        texts += [b" ".join(words[first + k : first + k + WINDOW]) for k in range(many)]
                        offset += range(many)
                    else:
                        route.append(key)
                        texts.append(b" ".join(words[first : first + many + WINDOW - 1]))
                        offset.append(0)
                    new = len(route) - len(which)
                    which += [j] * new
                    own += [i] * new
            if route:
                cols = (np.array(route, np.int64), keys[which], ctxs[which], docs[own], np.array(offset, np.int32))
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(texts, pa.binary())], ["route", "key", "ctx", "doc", "offset", "words"])


def search_shard(spans: list[bytes], docs: np.ndarray, block: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """(span, window in it) of each window that an earlier document holds too, by an FM-index of all spans."""
    lists = [s.split() for s in spans]
    size = np.array([len(x) for x in lists])
    flat = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    ends = np.cumsum(size)
    text = np.insert(flat, ends, 0)  # a separator, 0, after each span
    start = np.concatenate(([0], (ends + np.arange(1, len(ends) + 1))[:-1]))
    owner = np.repeat(np.arange(len(lists)), size + 1)
    index = FMIndex(text, WINDOW)
    by_suffix = docs[owner[index.order]]
    count = np.maximum(size - WINDOW + 1, 0)
    span = np.repeat(np.arange(len(lists)), count)
    offset = np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count)
    at = start[span] + offset
    hit = np.zeros(len(span), bool)
    for k in range(0, len(span), block):
        p = at[k : k + block, None] + np.arange(WINDOW)
        low, high, length = index.search(text[p])
        full = length == WINDOW
        u, back = np.unique(low, return_inverse=True)
        top = np.zeros(len(u), np.int64)
        top[back] = high
        # ranges of whole windows are disjoint: the least document of each, between its borders
        borders = np.stack((u, np.minimum(top, len(by_suffix) - 1)), axis=1).ravel()
        least = np.minimum.reduceat(by_suffix, borders)[::2] if len(u) else top
        least = np.where(top == len(by_suffix), np.minimum(least, by_suffix[-1]), least) if len(u) else least
        hit[k : k + block] = full & (least[back] < docs[span[k : k + block]])
    return span[hit], offset[hit]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard's contexts with the windows found, as bits."""
    held: list[pa.RecordBatch] = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    spans = t.column("words").to_pylist()
    docs, offset = (t.column(c).to_numpy() for c in ("doc", "offset"))
    span, window = search_shard(spans, docs)
    if len(span):
        bits = np.left_shift(np.int64(1), (offset[span] + window).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[span]) for c in ("key", "ctx")] + [pa.array(bits)], ["key", "ctx", "mask"])


def _removed(n: int, first: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a marked window; bit k of a mask marks the window k words after its ``first``."""
    start = (first[:, None].astype(np.int64) + np.arange(SPAN))[(mask[:, None] >> np.arange(SPAN)) & 1 == 1]
    start = start[start + WINDOW <= n]
    return np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(start + WINDOW, minlength=n + 1))[:n] > 0


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        borders, (firsts, masks) = _listed(b.column(2), "first", "mask")
        rows = []
        for i, (doc, z) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            words, cut = _unsqueezed(z).split(), 0
            n, part = len(words), slice(borders[i], borders[i + 1])
            if part.start < part.stop:
                gone = _removed(n, firsts[part], masks[part])
                cut = int(gone.sum())
                words = list(compress(words, (~gone).tolist()))
            rows.append((doc, n, cut, hashlib.sha256(b" ".join(words)).hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def duplicate_windows(docs: DataFrame) -> DataFrame:
    """(doc, version, marks): first word and bits of the windows that a document with a smaller doc_id holds too.

    ``docs``: doc_id, version (see ``with_version``), text.
    """
    docs = docs.filter(F.col("doc_id").isNotNull())
    every = settle(docs.mapInArrow(tidy(_anchor_rows), "key long, ctx long, doc long, version long, first int, many int"), "sub-all-anchors")
    # counted first, joined then: a plain join, whose skewed keys the planner splits
    shared = settle(every.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("key"), "sub-shared")
    found = settle(every.join(shared, "key"), "sub-anchors")
    discard(every, shared)
    ctxs = found.groupBy("key", "ctx").agg(F.min(F.struct("doc", "version", "first", "many")).alias("m"))
    ctxs = settle(ctxs.select("key", "ctx", "m.*"), "sub-contexts")
    several = ctxs.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", (F.col("n") > TOGETHER).alias("large"))
    todo = ctxs.join(several, "key").groupBy("doc", F.col("version").alias("_version")).agg(F.collect_list(F.struct("key", "ctx", "first", "many", "large")).alias("todo"))
    squeezed = docs.mapInArrow(tidy(_squeezed), "doc_id long, version long, z binary")
    routed = squeezed.join(todo, (F.col("doc_id") == F.col("doc")) & (F.col("version") == F.col("_version"))).select("doc_id", "z", "todo")
    routed = settle(routed.mapInArrow(tidy(_contexts), "route long, key long, ctx long, doc long, offset int, words binary"), "sub-routed")
    shards = max(1, -(-routed.count() // SHARD))
    masks = routed.repartition(shards, "route").mapInArrow(tidy(_search), "key long, ctx long, mask long")
    masks = masks.groupBy("key", "ctx").agg(F.bit_or("mask").alias("mask"))
    verdict = settle(ctxs.select("key", "ctx", F.col("doc").alias("least")).join(masks, ["key", "ctx"], "left"), "sub-verdict")
    discard(routed)
    whole = F.expr("shiftleft(1L, many) - 1")
    marks = found.join(verdict, ["key", "ctx"]).select("doc", "version", "first", F.when(F.col("doc") > F.col("least"), whole).otherwise(F.coalesce("mask", F.lit(0).cast("long"))).alias("mask"))
    marks = settle(marks.filter("mask <> 0").groupBy("doc", "version").agg(F.collect_list(F.struct("first", "mask")).alias("marks")), "sub-marks")
    discard(found, ctxs, verdict)
    return marks


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document.

    A null text is empty. A null doc_id is neither before nor after another: its row loses
    nothing and no other row loses anything for it. Rows that share a doc_id lose nothing for one
    another; each is cut by its own windows. Very long texts are taken whole. Only doc_id and
    text are read, so other columns may bear any name. An empty table gives none.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = with_version(docs, repeated_ids(docs)).select("doc_id", "version", "text")
    marks = duplicate_windows(docs).withColumnRenamed("version", "_version")
    texts = docs.mapInArrow(tidy(_squeezed), "doc_id long, version long, z binary")
    both = texts.join(marks, (F.col("doc_id") == F.col("doc")) & (F.col("version") == F.col("_version")), "left").select("doc_id", "z", "marks")
    return both.mapInArrow(tidy(_result), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated windows cut out of their texts, all columns kept.

    A text that loses words has the rest joined by single spaces; others stay as they are.
    A document that loses all its words goes.
    """
    ship(docs.sparkSession)
    repeated = repeated_ids(docs)
    rows = with_version(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), repeated).select("doc_id", "version", "text")
    version, doc, text, mark = unused(docs.columns, "cut_version", "cut_doc", "cut_text", "cut_marks")
    marks = duplicate_windows(rows).select(F.col("doc").alias(doc), F.col("version").alias(text), F.col("marks").alias(mark))
    named = with_version(docs, repeated, name=version)
    both = named.join(marks, (F.col("doc_id") == F.col(doc)) & (F.col(version) == F.col(text)), "left")
    names = docs.columns
    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                c = b.slice(k, 128)
                texts = c.column(at).to_pylist()
                borders, (firsts, masks) = _listed(c.column(c.num_columns - 1), "first", "mask")
                for i, (low, high) in enumerate(pairwise(borders)):
                    if low < high and texts[i] is not None:
                        words = texts[i].encode().split()
                        gone = _removed(len(words), firsts[low:high], masks[low:high])
                        if gone.any():
                            texts[i] = b" ".join(compress(words, (~gone).tolist())).decode() or None
                stays = pa.compute.or_(c.column(at).is_null(), pa.array([t is not None for t in texts]))
                cols = [c.column(j) if j != at else pa.array(texts, c.column(at).type) for j in range(c.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(cols, names=names).filter(stays)

    return both.select(*docs.columns, mark).mapInArrow(tidy(cut), docs.schema)


def _query(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS s
  FROM t WHERE len(w) >= 13
), m AS (
  SELECT s, min(doc_id) AS least FROM g GROUP BY s
), d AS (
  SELECT g.doc_id, list(g.i) AS starts FROM g JOIN m USING (s) WHERE least < g.doc_id GROUP BY g.doc_id
), x AS (
  SELECT DISTINCT doc_id, unnest(starts) + unnest_k AS j FROM d, (SELECT unnest(range(0, 13)) AS unnest_k)
), y AS (
  SELECT doc_id, list(j) AS gone FROM x GROUP BY doc_id
), k AS (
  SELECT t.doc_id, len(w) AS n, coalesce(len(gone), 0) AS r,
         CASE WHEN gone IS NULL THEN w ELSE list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains(gone, i) THEN NULL ELSE w[i] END), lambda v: v IS NOT NULL) END AS rest
  FROM t LEFT JOIN y USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM k
"""

QUERIES = {"op9_substring_dedup": _query}
ORACLES = {"op9_substring_dedup": SQL}
