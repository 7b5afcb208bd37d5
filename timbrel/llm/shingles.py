"""Word shingles of a text as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

MASK = (1 << 64) - 1
#: Odd factors of a window's places.
_FACTORS = [(0xD6E8FEB86659FD93 * (2 * k + 1) ** 3 + 2 * k * 0x9E3779B97F4A7C15 | 1) & MASK for k in range(16)]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word; a word's hash is the same in every process."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=">u8").astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` word hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    # word hashes are even already: their sum with odd factors by place needs mixing only at the end
    out = h[:m] * np.uint64(_FACTORS[0])
    for k in range(1, n):
        out += h[k : k + m] * np.uint64(_FACTORS[k % len(_FACTORS)] * (1 + 2 * (k // len(_FACTORS))) & MASK)
    out += np.uint64(0x9E3779B97F4A7C15 * n & MASK)
    return mix(out)


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Distinct ``n``-word shingles, sorted; all words as one if there are fewer; A-Z folded."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = word_hashes(words)
    return np.unique(windows(h, min(n, len(words))))
