"""Suffix-array de-duplication of byte strings.

Strings that occur nowhere else are sifted out before anything is sorted, without loss: equal
strings of 400 bytes have the same minimiser (the least hash among their short runs of bytes), so
only places whose minimiser occurs twice can hold a repeat; and a minimiser's whole context, the
bytes of all strings it governs, settles them at once if it occurs twice. The other contexts are
dealt by minimiser, so all places of a string meet; there the difference-cover algorithm sorts
sampled triples, recurses on their names and merges the remaining suffixes, and neighbours'
prefixes are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, ship, table, tidy
from .shingles import mix
from .suffix_array import repeated_starts

#: Bytes of a string, and of the runs among which its minimiser is chosen.
LENGTH, RUN = 400, 256
SPAN = LENGTH - RUN + 1
#: Contexts of one minimiser that stay together; larger groups are counted by string. Bytes of a shard.
TOGETHER, SHARD = 1500, 1_000_000
#: Strings of one text that are looked at together.
_STEP = 1 << 20
#: Powers of the hash's base that a worker keeps.
KEPT = 1 << 14
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    p = _POWERS.get(base)
    if p is None or len(p) < n:
        p = np.full(max(KEPT, n), base, dtype=np.uint64)
        p[0] = 1
        p = np.multiply.accumulate(p)
        _POWERS[base] = p[:KEPT].copy()  # those of a very long text go with it
    return p[:n]


class Rolling:
    """Hashes of any substrings of a text, from sums over its prefixes (modulo 2^64)."""

    def __init__(self, text: np.ndarray):
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[text] * _power(_BASE, len(text)), dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        # powers are taken of places inside this text: equal strings get equal hashes anywhere
        return mix((self.sums[end] - self.sums[start]) * _power(_INVERSE, len(self.sums))[start])

    def all(self, n: int) -> np.ndarray:
        m = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:m]) * _power(_INVERSE, len(self.sums))[:m])


def least_places(g: np.ndarray, span: int) -> np.ndarray:
    """Place of the leftmost least of each ``span`` neighbours, by minima from both ends of blocks."""
    n = len(g) - span + 1
    full = -(-len(g) // span) * span
    x = np.full(full, np.iinfo(np.uint64).max, dtype=np.uint64)
    x[: len(g)] = g
    x = x.reshape(-1, span)
    place = np.arange(full).reshape(-1, span)
    ahead = np.minimum.accumulate(x, axis=1)
    fresh = np.ones(x.shape, dtype=bool)
    fresh[:, 1:] = x[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(fresh, place, 0), axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1]
    back_at = np.minimum.accumulate(np.where(x == back, place, full)[:, ::-1], axis=1)[:, ::-1].ravel()
    left, right = back.ravel()[:n], ahead.ravel()[span - 1 : span - 1 + n]
    return np.where(left <= right, back_at[:n], ahead_at[span - 1 : span - 1 + n])


def anchors(text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """key, context hash, first string and number of strings of each minimiser of a text."""
    total = len(text) - LENGTH + 1
    for begin in range(0, total, _STEP):
        part = text[begin : begin + _STEP + LENGTH - 1]
        r = Rolling(part)
        g = r.all(RUN)
        at = least_places(g, SPAN)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        many = np.diff(np.append(first, len(at)))
        ctx = mix(r.of(first, first + many + LENGTH - 1) + many.astype(np.uint64) * np.uint64(1009) + (at[first] - first).astype(np.uint64))
        yield g[at[first]], ctx, first + begin, many


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in range(0, b.num_rows, 64):
            c = b.slice(row, 64)
            out: list[list] = [[] for _ in range(4)]
            ids, marks, sizes = [], [], []
            for i, th, t in zip(*(c.column(k).to_pylist() for k in (0, 1)), c.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if t is None or len(t) < LENGTH:
                    continue
                for found in anchors(np.frombuffer(t, dtype=np.uint8)):
                    for x, v in zip(out, found, strict=True):
                        x.append(v)
                    ids.append(i)
                    marks.append(th)
                    sizes.append(len(found[0]))
            if ids:
                key, ctx, first, many = (np.concatenate(x) for x in out)
                which = np.repeat(np.arange(len(ids)), sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(ids, pa.int64()).take(pa.array(which)), pa.array(marks, pa.int64()).take(pa.array(which)), pa.array(first.astype(np.int64)), pa.array(many.astype(np.int32))],
                    ["key", "ctx", "doc", "th", "first", "many"],
                )


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        for at in range(0, b.num_rows, 256):
            c = b.slice(at, 256)
            yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array([z.compress(t or b"") for t in c.column(2).cast(pa.binary()).to_pylist()], pa.binary())], ["doc_id", "th", "z"])


def _unsqueezed(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z) if z else b""


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(route, key, ctx, offset, text): a context with its bytes, or for a large group each string's hash without them."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for b in batches:
        for z, todo in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            text = _unsqueezed(z)
            rows, done = [], set()
            for x in todo:
                if (x["key"], x["ctx"]) in done:
                    continue  # the same row of the table, repeated
                done.add((x["key"], x["ctx"]))
                part = text[x["first"] : x["first"] + x["many"] + LENGTH - 1]
                if not x["large"]:
                    rows.append((x["key"], x["key"], x["ctx"], 0, part))
                else:
                    h = Rolling(np.frombuffer(part, dtype=np.uint8)).all(LENGTH).view(np.int64)
                    rows += [(int(h[k]), x["key"], x["ctx"], k, None) for k in range(x["many"])]
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 4096], strict=True), kinds, strict=True)], ["route", "key", "ctx", "offset", "text"])


def search_shard(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(part, place in it) of each string that starts at two places of the parts."""
    size = np.array([len(p) for p in parts], dtype=np.int64)
    text = np.frombuffer(b"\x00".join(parts) + b"\x00", dtype=np.uint8).astype(np.int64) + 2
    ends = np.cumsum(size + 1) - 1
    text[ends] = 1  # below all bytes
    begin = ends - size
    count = size - LENGTH + 1
    part = np.repeat(np.arange(len(parts)), count)
    place = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)
    hit = np.sort(repeated_starts(text, begin[part] + place, LENGTH))
    which = np.searchsorted(ends, hit)
    return which, hit - begin[which]


def _spans(key: np.ndarray, ctx: np.ndarray, part: np.ndarray, place: np.ndarray) -> pa.RecordBatch | None:
    """Neighbouring places of a part as one row (key, ctx, low, high)."""
    if not len(part):
        return None
    new = np.concatenate(([True], (part[1:] != part[:-1]) | (place[1:] != place[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(part)) - 1
    return pa.RecordBatch.from_arrays([pa.array(key[part[first]]), pa.array(ctx[part[first]]), pa.array(place[first].astype(np.int32)), pa.array(place[last].astype(np.int32))], ["key", "ctx", "low", "high"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    key, ctx = t.column("key").to_numpy(), t.column("ctx").to_numpy()
    texts = t.column("text")
    del held
    # whole groups of a key, up to a shard's size at a time
    order = np.argsort(key, kind="stable")
    lengths = np.asarray(pa.compute.binary_length(texts))[order].astype(np.int64)
    at = 0
    while at < len(order):
        total, end = 0, at
        while end < len(order) and (total < SHARD or key[order[end]] == key[order[end - 1]]):
            total += int(lengths[end])
            end += 1
        rows = order[at:end]
        part, place = search_shard(texts.take(pa.array(rows)).to_pylist())
        found = _spans(key[rows], ctx[rows], part, place)
        if found is not None:
            yield found
        at = end


def _gone(n: int, marks: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal byte ranges that marked strings cover."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((x["low"], x["high"]) for x in marks or ()):
        end = high + LENGTH
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((low, end))
    return out


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, z, marks in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            text = _unsqueezed(z)
            gone = _gone(len(text), marks)
            digest, at = hashlib.sha256(), 0
            for low, end in gone:
                digest.update(text[at:low])
                at = end
            digest.update(text[at:])
            rows.append((doc, len(text), sum(e - a for a, e in gone), len(gone), digest.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_strings(rows: DataFrame) -> DataFrame:
    """(doc, th, marks): ranges of starts of strings that start anywhere else too; ``rows``: doc_id, th, text."""
    every = settle(rows.mapInArrow(tidy(_anchor_rows), "key long, ctx long, doc long, th long, first long, many int"), "suffix-all-anchors")
    # counted first, joined then: a plain join, whose skewed keys the planner splits
    shared = settle(every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "suffix-shared")
    found = settle(every.join(shared, "key"), "suffix-anchors")
    discard(every, shared)
    ctxs = found.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc", "th", "first", "many")).alias("m"))
    ctxs = settle(ctxs.select("key", "ctx", "n", "m.*"), "suffix-contexts")
    # a context met once may share strings with another of its minimiser
    several = ctxs.groupBy("key").agg(F.count("*").alias("c"), F.min("n").alias("least")).filter("c > 1 AND least = 1")
    todo = ctxs.join(several.select("key", (F.col("c") > TOGETHER).alias("large")), "key")
    todo = todo.groupBy("doc", "th").agg(F.collect_list(F.struct("key", "ctx", "first", "many", "large")).alias("todo"))
    squeezed = rows.mapInArrow(tidy(_squeezed), "doc_id long, th long, z binary")
    same = F.col("doc_id").eqNullSafe(F.col("doc")) & (squeezed["th"] == todo["th"])
    routed = squeezed.join(todo, same).select("z", "todo").mapInArrow(tidy(_contexts), "route long, key long, ctx long, offset int, text binary")
    routed = settle(routed, "suffix-routed")
    small, large = routed.filter("text IS NOT NULL"), routed.filter("text IS NULL").drop("text").distinct()
    total = small.agg(F.sum(F.length("text"))).first()[0] or 0
    spans = small.repartition(max(1, -(-int(total) // (2 * SHARD))), "route").select("key", "ctx", "text").mapInArrow(tidy(_search), "key long, ctx long, low int, high int")
    twice = large.groupBy("route").agg(F.count("*").alias("n")).filter("n > 1").select("route")
    spans = spans.unionByName(large.join(twice, "route").select("key", "ctx", F.col("offset").alias("low"), F.col("offset").alias("high")))
    once = ctxs.filter("n = 1").join(spans, ["key", "ctx"]).select("doc", "th", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))
    again = found.join(ctxs.filter("n > 1").select("key", "ctx"), ["key", "ctx"]).select("doc", "th", F.col("first").alias("low"), (F.col("first") + F.col("many") - 1).alias("high"))
    marks = settle(once.unionByName(again).groupBy("doc", "th").agg(F.collect_list(F.struct("low", "high")).alias("marks")), "suffix-marks")
    discard(found, ctxs, routed)
    return marks


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    A null text is empty. Rows count as places of their own: two equal rows of 400 bytes or more
    are removed whole, null or repeated doc_ids make no difference. Very long texts are taken
    whole. Only doc_id and text are read, so other columns may bear any name; an empty table
    gives none.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    marks = repeated_strings(rows).withColumnRenamed("th", "_th")
    both = rows.mapInArrow(tidy(_squeezed), "doc_id long, th long, z binary").join(marks, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("th") == F.col("_th")), "left")
    return both.select("doc_id", "z", "marks").mapInArrow(tidy(_result), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _query(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op6_suffix_dedup": _query}
ORACLES: dict[str, str] = {}
