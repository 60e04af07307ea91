"""The extended binary Golay code of 24 bits, and the codewords near a word.

The code has 4096 codewords, each named by its upper 12 bits. Every 24-bit word lies within distance 4
of either one codeword or six. If two words differ in at most one bit they share one of those: a word
at distance at most 3 of a codeword leaves its neighbour within 4, and of two neighbours at least one
has such a codeword, because their distances to the code differ in parity.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial of the 23-bit code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _parity_bits(info: int) -> int:
    """The lower 12 bits of a codeword: the remainder of the cyclic code, then a bit for even weight."""
    rest = info << 11
    for bit in range(22, 10, -1):
        if rest >> bit & 1:
            rest ^= GENERATOR << (bit - 11)
    word = (info << 11 | rest) << 1
    return (word | word.bit_count() & 1) & 0xFFF


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity by information bits; and by syndrome up to six error patterns of the least weight, and their number."""
    parity = np.fromiter(map(_parity_bits, range(4096)), np.int64, 4096)
    leaders = np.zeros((4096, 6), np.int64)
    number = np.zeros(4096, np.int64)
    weight = np.full(4096, 99)
    for w in range(5):
        for bits in combinations(range(24), w):
            error = sum(1 << b for b in bits)
            syndrome = (error & 0xFFF) ^ parity[error >> 12]
            if weight[syndrome] >= w:
                weight[syndrome] = w
                leaders[syndrome, number[syndrome]] = error
                number[syndrome] += 1
    return parity, leaders, number


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 24-bit words, the 12-bit names of all codewords within distance 4, as (row of ``words``, name)."""
    parity, leaders, number = tables()
    syndrome = (words & 0xFFF) ^ parity[words >> 12]
    each = number[syndrome]
    row = np.repeat(np.arange(len(words)), each)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    return row, (words[row] ^ leaders[syndrome[row], nth]) >> 12
