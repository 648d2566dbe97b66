"""Winnowed byte anchors of one text, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .shingles import _M2, mix

SPAN = 100  # bytes of a string that counts as repeated
BLOCK = 1 << 20  # positions handled at a time; they fill the low 20 bits
_LOW = np.uint64(BLOCK - 1)
_BYTE = mix(mix(np.arange(1, 257, dtype=np.uint64) * _M2))


def _ahead_min(m: np.ndarray, width: int) -> np.ndarray:
    got = 1
    while got < width:
        step = min(got, width - got)
        m = np.minimum(m[:-step], m[step:])
        got += step
    return m


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` bytes (``k`` a power of two), by doubling: a sum
    of random byte values times odd constants, mixed at the end."""
    h, size = _BYTE[b], 1
    factor = int(_M2)
    while size < k:
        low = h[:-size] * np.uint64(factor)
        low += h[size:]
        h, size, factor = low, size * 2, factor * int(_M2) % 2**64 | 1
    return mix(h)


def anchors(body: bytes, k: int = 32, span: int = SPAN) -> Iterator[tuple[np.ndarray, ...]]:
    """For every run of starts of ``span``-byte strings that have the same
    smallest ``k``-byte hash at the same place (the first of equals): hash,
    hash of all bytes of the run's strings, first start, place of the anchor
    from there, number of starts.

    Which place a string has depends on its bytes alone, so equal strings
    meet under equal hashes.  Long texts come in blocks, each start once.
    """
    b = np.frombuffer(body, np.uint8)
    starts = len(b) - span + 1
    for at in range(0, max(starts, 0), BLOCK - 2 * span):
        part = b[at:at + BLOCK - 2 * span + span - 1]
        g = gram_hashes(part, k)
        packed = (g & ~_LOW) | np.arange(len(g), dtype=np.uint64)
        place = (_ahead_min(packed, span - k + 1) & _LOW).astype(np.int64)
        edge = np.flatnonzero(np.diff(place)) + 1
        lo = np.concatenate([[0], edge])
        n = np.diff(np.concatenate([lo, [len(place)]]))
        last = lo + n - 1
        # two strings cover the run: it is shorter than twice the span
        content = mix(n.astype(np.uint64) * _M2)
        for s in (lo, last):
            for d in (*range(0, span - k, k), span - k):
                content = mix(content * _M2 + g[s + d])
        yield g[place[lo]], content, lo + at, place[lo] - lo, n
