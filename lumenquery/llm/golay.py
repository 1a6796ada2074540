"""The binary Golay code (23,12): nearest codewords, and keys that words within two bits share.

A perfect code: every 23-bit word has exactly one codeword within three bits, so error patterns of
weight 0 to 3 and syndromes pair off. A word's keys are the indices of the codewords nearest to it
and to its 23 one-bit neighbours: one key if its codeword is at distance 2 or less, six otherwise.
Words that differ in at most two bits have a common one-bit neighbour (or are neighbours), hence a
common key.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS = 23
CHECK_BITS = 11
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _remainder(word: int) -> int:
    for bit in range(BITS - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


_ONE = [_remainder(1 << i) for i in range(BITS)]


def _syndromes(first: int, count: int) -> np.ndarray:
    values = np.arange(1 << count)
    out = np.zeros(1 << count, dtype=np.int32)
    for i in range(count):
        out ^= np.where(values >> i & 1, _ONE[first + i], 0).astype(np.int32)
    return out


_LOW, _HIGH = _syndromes(0, 12), _syndromes(12, 11)
_LEADER = np.zeros(1 << CHECK_BITS, dtype=np.int32)
for _weight in range(4):
    for _places in combinations(range(BITS), _weight):
        _syn, _err = 0, 0
        for _i in _places:
            _syn ^= _ONE[_i]
            _err |= 1 << _i
        _LEADER[_syn] = _err


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the nearest codeword of each 23-bit word."""
    words = words.astype(np.int32)
    return (words ^ _LEADER[_LOW[words & 0xFFF] ^ _HIGH[words >> 12]]) >> CHECK_BITS


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of each word, without repeats."""
    words = words.astype(np.int32)
    found = np.empty((len(words), BITS + 1), dtype=np.int32)
    found[:, 0] = nearest(words)
    for i in range(BITS):
        found[:, i + 1] = nearest(words ^ (1 << i))
    found.sort(axis=1)
    fresh = np.ones(found.shape, dtype=bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    row, _ = np.nonzero(fresh)
    return row, found[fresh]
