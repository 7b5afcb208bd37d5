"""Ratcliff-Obershelp similarity with whole numbers as sets of places, equal to ``difflib.SequenceMatcher(None, a, b).ratio()``."""

from __future__ import annotations

from collections import Counter

import numpy as np


def _places(text: str, chars: list[str]) -> dict[str, int]:
    """Where each of ``chars`` stands in ``text``, a bit for each place."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    wanted = np.array([ord(c) for c in chars], "<u4")
    bits = np.packbits(codes == wanted[:, None], axis=1, bitorder="little")
    return {c: int.from_bytes(b.tobytes(), "little") for c, b in zip(chars, bits, strict=True)}


def _longest(runs: list[list[int]], r0: int, r1: int, c0: int, c1: int) -> tuple[int, list[tuple[int, int]]]:
    """Length of the longest run in rows [r0, r1) and columns [c0, c1), and (row, bits of columns from c0) where such runs begin."""
    most = min(r1 - r0, c1 - c0)
    for e in range(min(len(runs), most.bit_length()) - 1, -1, -1):
        n = 1 << e
        mask = (1 << (c1 - c0 - n + 1)) - 1
        found = [(r, y) for r, x in enumerate(runs[e][r0 : r1 - n + 1], r0) if x and (y := x >> c0 & mask)]
        if found:
            break
    else:
        return 0, []
    while e:  # longer by halves, as far as any run goes
        e -= 1
        longer = n + (1 << e)
        if longer <= most:
            mask = (1 << (c1 - c0 - longer + 1)) - 1
            more = [(r, y) for r, x in found if r + longer <= r1 and (y := x & (runs[e][r + n] >> (c0 + n)) & mask)]
            if more:
                found, n = more, longer
    return n, found


def ratio(a: str, b: str) -> float:
    """Twice the characters in common blocks over all characters; of 200 characters of ``b`` and more, frequent ones begin no block.

    The shorter text's characters are rows, the longer's places bits of one number a row: ``runs[e][row]`` tells where
    a common run of 2**e begins. A block is the longest run, of these the first in ``a``, then in ``b``.
    """
    if not a or not b:
        return 0.0 if a or b else 1.0
    frequent = {c for c, n in Counter(b).items() if n > len(b) // 100 + 1} if len(b) >= 200 else set()
    swapped = len(a) < len(b)
    short, long = (a, b) if swapped else (b, a)
    places = _places(long, list(set(short) - frequent)) if set(short) - frequent else {}
    runs = [[places.get(c, 0) for c in short]]
    while len(runs[-1]) > (n := 1 << (len(runs) - 1)):
        longer = [x and x & (y >> n) for x, y in zip(runs[-1], runs[-1][n:], strict=False)]
        if not any(longer):
            break
        runs.append(longer)
    total, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        size, found = _longest(runs, a0, a1, b0, b1) if swapped else _longest(runs, b0, b1, a0, a1)
        i, j = a0, b0
        if found and swapped:
            row, bits = found[0]
            i, j = row, b0 + (bits & -bits).bit_length() - 1
        elif found:
            first, j = min(((bits & -bits).bit_length(), row) for row, bits in found)
            i = a0 + first - 1
        if frequent:  # they only lengthen a block
            while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < a1 and j + size < b1 and a[i + size] == b[j + size]:
                size += 1
        if size:
            total += size
            if a0 < i and b0 < j:
                open_.append((a0, i, b0, j))
            if i + size < a1 and j + size < b1:
                open_.append((i + size, a1, j + size, b1))
    return 2.0 * total / (len(a) + len(b))
