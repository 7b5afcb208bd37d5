"""Hierarchical multi-length packing.

Whole windows are cut off long documents; what is left of each is routed to the smallest
context tier that holds it. Tiers are packed from the longest down. A gap in a window is filled
with the largest rests of shorter tiers that fit, and at last by cutting one, so windows are full.
Sequences are then dealt to step groups of about the same number of tokens.

Each partition packs its own documents in one streaming pass with a bounded pool, so nothing is
shuffled and a lost task repeats the same work on the same rows.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import byte_slices, ship, table, tidy

TIERS = (2048, 1024, 512, 256)
#: Tokens of rests held before a pool is packed, of one step group, and of windows dealt to groups at once.
POOL_TOKENS, STEP_TOKENS, DEALT_TOKENS = 1 << 20, 1 << 17, 1 << 23
#: Pieces of one generation of the cache (two are kept, so frequent ones stay), and bytes of text encoded at once.
CACHE, SLICE = 200_000, 8_000_000
#: Marks after a letter that end a word; the tokenizer splits before them.
_MARKS = ".,!?;:*$%&#"
#: Letters that stay one letter when case is folded and text is composed.
_LETTER = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]$"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens int, tier int, step_group long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Generations:
    """A cache of two generations: what is asked for in the younger one's time outlives the older."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, keys: list) -> list:
        """Values of ``keys``, None where there is none."""
        found = list(map(self.young.get, keys))
        if self.old:
            for i, v in enumerate(found):
                if v is None and (v := self.old.get(keys[i])) is not None:
                    found[i] = self.young[keys[i]] = v
        return found

    def turn(self) -> None:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


class Encoder:
    """Ids of many texts at once.

    If the tokenizer's file says that white space is dropped, case is folded and a run of letters
    never joins a mark, each distinct folded word between ASCII white space, less the marks at its
    end, is encoded once while it is kept, and texts are put together from words by places.
    Otherwise whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the executor's cores are taken by its tasks
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.by_word = _by_word(spec)
        suffix = spec["model"].get("end_of_word_suffix")
        # tokens that end a run of letters
        self.ends = np.array([bool(suffix) and (self.tok.id_to_token(i) or "").endswith(suffix) for i in range(self.tok.get_vocab_size())])
        self.forget()

    def forget(self) -> None:
        self.known = Generations(CACHE)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_runs(self, runs: list[str]) -> list[bytes]:
        """The same for runs of letters, many in one text: a token that ends a run shows where the next begins."""
        out: list[bytes] = []
        for part, e in zip(parts := [runs[k : k + 512] for k in range(0, len(runs), 512)], self.tok.encode_batch_fast([" ".join(x) for x in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=np.uint32)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(part) and last[-1] == len(ids):
                raw = ids.tobytes()
                ends = (4 * last).tolist()
                out += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            else:
                out += self.encode(part)
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` (strings, null for empty), and the border of each text's among them."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            made = self.encode(texts.to_pylist())
            return np.frombuffer(b"".join(made), dtype=np.uint32), np.concatenate(([0], np.cumsum([len(x) // 4 for x in made], dtype=np.int64)))
        # a special token's name keeps its case
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        borders = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        # a distinct word is a core and the marks after it, if the core ends in a letter
        distinct = coded.dictionary
        core = pc.utf8_rtrim(distinct, _MARKS)
        core = pc.if_else(pc.match_substring_regex(pc.utf8_slice_codeunits(core, -1), _LETTER), core, distinct)
        marks = pc.subtract(pc.binary_length(distinct), pc.binary_length(core))
        marked = pc.greater(marks, 0)
        ends = pa.array([w[-n:] for w, n in zip(distinct.filter(marked).to_pylist(), marks.filter(marked).to_pylist(), strict=True)], pa.string())
        pieces = pa.concat_arrays([core, ends]).dictionary_encode()
        made = self.ids_of(pieces.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(made), dtype=np.uint32)
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        # cores, each with its marks behind it, then all words of the texts
        at = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        which = pieces.indices.to_numpy()
        which, back = np.insert(which[: len(core)], at + 1, which[len(core) :]), np.insert(np.ones(len(core), np.int64), at + 1, 0)
        flat, edges = _gather(flat, size, which)
        edges = np.append(edges[:-1][back == 1], edges[-1])
        flat, edges = _gather(flat, np.diff(edges), coded.indices.to_numpy())
        return flat, edges[borders]

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        ids = self.known.get(pieces)
        fresh = [i for i, x in enumerate(ids) if x is None]
        letters, others = [i for i in fresh if pieces[i].isalpha()], [i for i in fresh if not pieces[i].isalpha()]
        for which, how in ((letters, self.encode_runs), (others, self.encode)):
            for i, made in zip(which, how([pieces[i] for i in which]), strict=True):
                ids[i] = self.known.young[pieces[i]] = made
        self.known.turn()
        return ids


def _gather(flat: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``flat``, whose runs have ``size`` members each, and the borders between them."""
    many = size[which]
    edges = np.concatenate(([0], np.cumsum(many)))
    place = np.repeat((np.cumsum(size) - size)[which] - edges[:-1], many)
    place += np.arange(len(place))
    return flat[place], edges


def _by_word(spec: dict) -> bool:
    """Whether the tokenizer works on each word between ASCII white space alone and folds case."""
    normal, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    kinds = [x["type"] for x in normal.get("normalizers", [normal] if normal else [])]
    first = (split.get("pretokenizers") or [split])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    return drops and "Lowercase" in kinds and set(kinds) <= {"NFC", "Replace", "Lowercase"}


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


class Pool:
    """Rests by length: the largest that fits a gap is found by bisection."""

    def __init__(self) -> None:
        self.by: dict[int, list] = {}
        self.sizes: list[int] = []

    def put(self, item: tuple) -> None:
        n = len(item[2])
        if n not in self.by:
            self.by[n] = []
            bisect.insort(self.sizes, n)
        self.by[n].append(item)

    def take(self, most: int) -> tuple | None:
        """The largest item of at most ``most`` tokens."""
        k = bisect.bisect_right(self.sizes, most)
        if not k:
            return None
        n = self.sizes[k - 1]
        item = self.by[n].pop()
        if not self.by[n]:
            del self.by[n]
            self.sizes.pop(k - 1)
        return item

    def __bool__(self) -> bool:
        return bool(self.sizes)


def pack_pool(items: list[tuple], tiers: tuple[int, ...], last: bool) -> tuple[list[tuple[int, list[tuple]]], list[tuple]]:
    """Full windows [(tier, pieces)] and the pieces left over. An item is (document, start, ids, document's tokens).

    ``last``: the rest is packed too, into windows of powers of two.
    """
    pool = Pool()
    for x in items:
        pool.put(x)
    done, left = [], []
    for k, tier in enumerate(tiers):
        low = tiers[k + 1] if k + 1 < len(tiers) else 0
        while pool and pool.sizes[-1] > low:
            row, gap = [], tier
            while gap and pool:
                x = pool.take(gap)
                if x is None:  # nothing fits whole: cut the smallest
                    x, rest = _cut(pool.take(pool.sizes[0]), gap)
                    pool.put(rest)
                row.append(x)
                gap -= len(x[2])
            if gap:
                left += row
            else:
                done.append((tier, row))
    if last and left:
        total = sum(len(x[2]) for x in left)
        queue = left[::-1]
        left = []
        while total:
            tier = min(tiers[0], 1 << (total.bit_length() - 1))
            row, gap = [], tier
            while gap:
                x = queue.pop()
                if len(x[2]) > gap:
                    x, rest = _cut(x, gap)
                    queue.append(rest)
                row.append(x)
                gap -= len(x[2])
            done.append((tier, row))
            total -= tier
    return done, left


def _cut(x: tuple, n: int) -> tuple[tuple, tuple]:
    doc, start, ids, tokens = x
    return (doc, start, ids[:n], tokens), (doc, start + n, ids[n:], tokens)


def _final(x: tuple) -> tuple[int, int, int, int, int]:
    """A piece without its ids: document, start, length, checksum, document's tokens."""
    return x[0], x[1], len(x[2]), zlib.crc32(x[2]), x[3]


def pack_partition(batches: Iterator[pa.RecordBatch], path: str, tiers: tuple[int, ...], end_id: int, part: int) -> Iterator[pa.RecordBatch]:
    enc, top = _encoder(path), tiers[0]
    end = np.array([end_id], dtype=np.uint32)
    made = steps = 0  # sequences and step groups so far
    rows: list[list] = [[] for _ in range(10)]
    waiting: list[tuple[int, list[tuple]]] = []  # windows that no step group has yet

    def deal() -> None:
        nonlocal made, steps
        # the longest first, dealt in turn: every step group gets its part of each tier
        waiting.sort(key=lambda w: -w[0])
        groups = max(1, round(sum(w[0] for w in waiting) / STEP_TOKENS))
        for i, (tier, pieces) in enumerate(waiting):
            offset = 0
            for doc, start, n, crc, tokens in pieces:
                for c, v in zip(rows, (doc, start, n, crc, tokens, (part << 33) + made, offset, tier, tier, (part << 33) + steps + i % groups), strict=True):
                    c.append(v)
                offset += n
            made += 1
        steps += groups if waiting else 0
        waiting.clear()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "tier", "step_group"]
    kinds = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.int64()]

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)
        for c in rows:
            c.clear()
        return out

    rests: list[tuple] = []
    held = whole = 0
    for b in byte_slices(batches, 1, SLICE):
        ids, borders = enc.batch(b.column(1))
        for doc, low, high in zip(b.column(0).to_pylist(), borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            tokens = high - low + 1
            full = tokens - tokens % top
            for s in range(0, full, top):
                piece = ids[low + s : min(low + s + top, high)]
                waiting.append((top, [_final((doc, s, piece if s + top < tokens else np.append(piece, end), tokens))]))
            whole += full
            if tokens > full:
                # a copy, so that the batch needn't stay
                rests.append((doc, full, np.append(ids[low + full : high], end), tokens))
                held += tokens - full
            if held >= POOL_TOKENS:
                windows, rests = pack_pool(rests, tiers, False)
                waiting += [(tier, [_final(x) for x in row]) for tier, row in windows]
                held = sum(len(x[2]) for x in rests)
                deal()
                whole = 0
            elif whole >= DEALT_TOKENS:
                deal()
                whole = 0
            if len(rows[0]) >= 8192:
                yield flush()
    windows, _ = pack_pool(rests, tiers, True)
    waiting += [(tier, [_final(x) for x in row]) for tier, row in windows]
    deal()
    enc.forget()  # the next task of this worker may be another operator's
    yield flush()


def pack(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = 1) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, tier, step_group.

    ``tiers`` are powers of two, the longest first. A null or empty text is the end id alone; a very
    long one is cut into whole windows and one rest. Of other columns nothing is read, so their
    names don't matter. Each partition deals its windows to step groups of ``STEP_TOKENS`` with the
    same part of each tier, rests and whole windows alike; its last group may be smaller.
    Each row is a document of its own, repeated rows and repeated or null ids too. A sequence
    lies in one partition; only the last rest of a partition is cut into powers of two below
    the shortest tier, so no sequence needs padding. An empty table gives no piece.
    """
    ship(docs.sparkSession)
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack_partition(batches, path, tiers, end_id, TaskContext.get().partitionId())

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(tidy(run), SCHEMA)


def _query(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": _query}
ORACLES: dict[str, str] = {}
