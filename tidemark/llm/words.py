"""Hashes of words and of runs of words, for whole texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

MAX_WORDS = 100_000
_U = np.uint64


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_known = _Known()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; those of at most about MAX_WORDS words are kept for reuse."""
    if len(_known) > MAX_WORDS:
        _known.clear()
    return np.fromiter(map(_known.__getitem__, words), _U, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all others (xor-shifts and odd factors)."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_FACTORS = mixed(np.arange(1, 65, dtype=_U)) | _U(1)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Of every k consecutive words, in order; k of up to 64."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.full(n, k, _U)
    for j in range(k):
        total += words[j : j + n] * _FACTORS[j]
    return mixed(total)
