"""Alignment of two texts by their longest common blocks, for texts of any length.

The blocks are those of the standard library's matcher without its heuristics: the longest common block, of equals the one that
begins first in the old text and then in the new, then the same on either side of it. The matcher takes time by the product of
the lengths; here the longest block of large pieces is found by halving its possible length, each length being tried on the
rolling hashes of all windows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np

#: Pieces whose lengths multiply to less are left to the plain matcher.
SMALL = 250_000
_BASE = np.uint64(0x9E3779B97F4A7C15)

Block = tuple[int, int, int]
Opcode = tuple[str, int, int, int, int]


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)


class Hashed:
    """Hashes of all windows of a text, for any width: differences of its prefix hashes."""

    def __init__(self, text: str, top: int) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        mixed = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(27)
        # Each code is weighted by its place from the end, so that equal windows agree once brought to one weight.
        self.n, self.top, self.weights = len(codes), top, _powers(top)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * self.weights[: self.n][::-1], dtype=np.uint64)])

    def windows(self, low: int, high: int, width: int) -> np.ndarray:
        """Hashes of the windows of ``width`` within ``low`` to ``high``, at the weight of ``top``, which no text is longer than."""
        starts = np.arange(low, high - width + 1)
        raw = self.sums[starts + width] - self.sums[starts]
        # A window that starts at s has its last code at weight n - s - width.
        return raw * self.weights[self.top - (self.n - starts - width)]


def _longest(a: str, b: str, ha: Hashed, hb: Hashed, piece: tuple[int, int, int, int]) -> Block:
    alo, ahi, blo, bhi = piece
    if (ahi - alo) * (bhi - blo) < SMALL:
        i, j, k = SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).find_longest_match()
        return alo + i, blo + j, k

    def common(width: int) -> np.ndarray:
        return np.isin(ha.windows(alo, ahi, width), hb.windows(blo, bhi, width))

    low, high = 0, min(ahi - alo, bhi - blo)  # some block of length low is common, none longer than high
    while low < high:
        middle = (low + high + 1) // 2
        if common(middle).any():
            low = middle
        else:
            high = middle - 1
    while low:
        for i in np.flatnonzero(common(low)):
            i = alo + int(i)
            j = b.find(a[i : i + low], blo, bhi)
            if j >= 0:  # else two hashes were equal by chance
                return i, j, low
        low -= 1
    return alo, blo, 0


def matching_blocks(a: str, b: str) -> list[Block]:
    """``(start in a, start in b, length)`` of the common blocks in order, neighbours that touch on both sides being one."""
    if a == b:
        return [(0, 0, len(a))] if a else []
    ha, hb = (Hashed(t, max(len(a), len(b))) for t in (a, b))
    todo, found = [(0, len(a), 0, len(b))], []
    while todo:
        piece = todo.pop()
        i, j, k = _longest(a, b, ha, hb, piece)
        if k:
            found.append((i, j, k))
            alo, ahi, blo, bhi = piece
            todo += [p for p in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)) if p[0] < p[1] and p[2] < p[3]]
    out: list[Block] = []
    for i, j, k in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + k)
        else:
            out.append((i, j, k))
    return out


def opcodes(a: str, b: str) -> Iterator[Opcode]:
    """The edits that lead from one text to the other: equal, replace, delete and insert with their ranges in both."""
    i = j = 0
    for ai, bj, size in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        if i < ai or j < bj:
            yield ("replace" if i < ai and j < bj else "delete" if i < ai else "insert"), i, ai, j, bj
        if size:
            yield "equal", ai, ai + size, bj, bj + size
        i, j = ai + size, bj + size


def occurrences(text: str, part: str) -> Iterator[int]:
    """Every place where a part stands, overlaps included."""
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def once(text: str, part: str) -> bool:
    first = text.find(part)
    return first >= 0 and text.find(part, first + 1) < 0
