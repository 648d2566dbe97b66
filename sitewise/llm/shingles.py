"""Word hashes and shingle sets of one text, with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0x9E3779B97F4A7C15)
_S33, _S32 = np.uint64(33), np.uint64(32)


class WordHashes(dict):
    """Memory of word hashes within one task, emptied when it has ``limit``
    words; it only saves time."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S33)
    x = x * _M1
    return x ^ (x >> _S32)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` items of ``h`` (as they follow each other)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc = mix(acc) + h[j:j + n] * _M2
    return mix(acc)


def shingle_set(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct ``k``-item shingle hashes; the whole sequence as one
    if it is shorter; empty if it is empty."""
    return np.unique(grams(h, min(k, len(h)))) if len(h) else np.zeros(0, np.uint64)
