"""The perfect binary Golay code of 23 bits: each word is at most 3 bits from just one codeword."""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
BITS, CHECK_BITS = 23, 11


def syndrome(words: np.ndarray) -> np.ndarray:
    left = words.astype(np.uint32)
    for bit in range(BITS - 1, CHECK_BITS - 1, -1):
        left = np.where(left >> np.uint32(bit) & np.uint32(1), left ^ np.uint32(GENERATOR << (bit - CHECK_BITS)), left)
    return left


@functools.cache
def errors() -> np.ndarray:
    """The one error of up to 3 bits for each syndrome."""
    patterns = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(BITS), n)], dtype=np.uint32)
    found = np.zeros(1 << CHECK_BITS, dtype=np.uint32)
    found[syndrome(patterns)] = patterns
    return found


def index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each word."""
    words = words.astype(np.uint32)
    return (words ^ errors()[syndrome(words)]) >> np.uint32(CHECK_BITS)


def indices(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For words whose upper BITS - bits are zero: the nearest index, and an array (words, bits) of the
    indices of all words one bit away; what repeats within a row is -1."""
    words = words.astype(np.uint32)
    found = index(words[:, None] ^ (1 << np.arange(bits)).astype(np.uint32)).astype(np.int64)
    found.sort(axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return index(words).astype(np.int64), found
