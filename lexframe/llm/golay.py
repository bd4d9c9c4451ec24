"""Nearby codewords of the binary Golay code [23, 12, 7], as fuzzy keys of bit segments."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, CHECK_BITS = 23, 11


def _remainder(v: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if v >> bit & 1:
            v ^= GENERATOR << (bit - CHECK_BITS)
    return v


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and for each syndrome its error patterns and their number.

    The code is perfect: every word is within 3 bits of one codeword. Listed are all patterns of up to 4
    bits. A word within 2 bits of a codeword has that one only; a word 3 bits away has five more at 4.
    """
    one = [_remainder(1 << i) for i in range(LENGTH)]

    def syndromes(first: int, bits: int) -> np.ndarray:
        out = np.zeros(1 << bits, dtype=np.int32)
        for i in range(bits):
            out[1 << i : 2 << i] = out[: 1 << i] ^ one[first + i]
        return out

    found: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
    for weight in range(5):
        for at in combinations(range(LENGTH), weight):
            s = p = 0
            for i in at:
                s, p = s ^ one[i], p | 1 << i
            found[s].append(p)
    patterns = np.array([x + [x[0]] * (6 - len(x)) for x in found], dtype=np.int32)
    return syndromes(0, 12), syndromes(12, 11), patterns, np.array([len(x) for x in found])


def codeword_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) indices of the codewords within 4 bits of each 23-bit word, and how many of them are distinct.

    Two words that differ in at most 2 bits have an index in common. (Between their codewords: if one
    is within 2 bits of its own, the other is within 4 of it. Else both are 3 away, and the codeword that covers
    those three bits and one in which they differ is within 4 of both.) The index is the word's 12 data bits.
    """
    low, high, patterns, counts = tables()
    s = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ patterns[s]) >> CHECK_BITS, counts[s]
