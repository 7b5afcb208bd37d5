"""Suffix arrays by a difference cover modulo three (Kärkkäinen, Sanders, Burkhardt, 2006), on whole arrays."""

from __future__ import annotations

import numpy as np


def _pack(*cols: np.ndarray) -> np.ndarray:
    """One whole number for each row, in the rows' lexicographic order."""
    bits = [int(c.max(initial=0)).bit_length() for c in cols]
    if sum(bits) > 63:
        order = np.lexsort(cols[::-1])
        new = np.zeros(len(order), dtype=bool)
        for c in cols:
            v = c[order]
            new[1:] |= v[1:] != v[:-1]
        out = np.empty(len(order), dtype=np.int64)
        out[order] = np.cumsum(new)
        return out
    out = np.zeros(len(cols[0]), dtype=np.int64)
    for c, b in zip(cols, bits, strict=True):
        out = (out << b) | c
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of ``s`` (whole numbers from 1) in the order of the suffixes; a shorter one comes before its extensions."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: list(s[i:])), dtype=np.int64)
    t = np.concatenate((s.astype(np.int64), np.zeros(3, np.int64)))
    # sampled positions: 1 and 2 modulo 3, with one beyond the end that keeps the two classes apart
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    at = np.concatenate((one, two))
    t = np.append(t, 0)
    names = np.unique(_pack(t[at], t[at + 1], t[at + 2]), return_inverse=True)[1].astype(np.int64) + 1
    if names.max() == len(names):
        sampled = np.argsort(names)
    else:
        sampled = suffix_array(names)
    rank = np.zeros(n + 4, dtype=np.int64)
    order = at[sampled]
    rank[order] = np.arange(1, len(order) + 1)
    order = order[order < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(_pack(t[zero], rank[zero + 1]), kind="stable")]
    # how many of the others come before each sampled suffix: one or two symbols, then sampled ranks
    m = order % 3 == 1
    a, b = order[m], order[~m]
    less = np.empty(len(order), dtype=np.int64)
    k = _pack(np.concatenate((t[zero], t[a])), np.concatenate((rank[zero + 1], rank[a + 1])))
    less[m] = np.searchsorted(k[: len(zero)], k[len(zero) :])
    k = _pack(np.concatenate((t[zero], t[b])), np.concatenate((t[zero + 1], t[b + 1])), np.concatenate((rank[zero + 2], rank[b + 2])))
    less[~m] = np.searchsorted(k[: len(zero)], k[len(zero) :])
    out = np.empty(n, dtype=np.int64)
    place = np.arange(len(order)) + less
    out[place] = order
    free = np.ones(n, dtype=bool)
    free[place] = False
    out[free] = zero
    return out


def repeated_starts(s: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Those of ``starts`` whose next ``length`` symbols follow another of them too: neighbours in suffix order are compared."""
    wanted = np.zeros(len(s), dtype=bool)
    wanted[starts] = True
    order = suffix_array(s)
    order = order[wanted[order]]
    if len(order) < 2:
        return order[:0]
    # eight symbols at a time while they agree
    wide = np.concatenate((s.astype(np.uint16), np.zeros(length + 8, np.uint16)))
    live = np.arange(len(order) - 1)
    for k in range(0, length, 4):
        step = min(4, length - k)
        x, y = order[live] + k, order[live + 1] + k
        same = np.ones(len(live), dtype=bool)
        for j in range(step):
            same &= wide[x + j] == wide[y + j]
        live = live[same]
    hit = np.zeros(len(order), dtype=bool)
    hit[live] = True
    hit[live + 1] = True
    return order[hit]
