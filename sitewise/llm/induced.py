"""Suffix arrays by induced sorting and permuted common prefixes, with numpy.

Suffixes are classified as smaller (S) or larger (L) than their successor.
Leftmost S suffixes (LMS) are sorted by their substrings up to the next one,
named, and the string of names is sorted recursively; the order of all other
suffixes is then induced in two passes over the buckets of first characters.
A bucket is handled in waves: all entries it has so far induce at once, so
the number of numpy calls goes with the alphabet and the longest run of one
character, not with the text.  Strings of names with an alphabet beyond
``WAVE_ALPHABET`` are sorted by doubling instead, as their buckets would be
too many and too small for waves.
"""

from __future__ import annotations

import numpy as np

WAVE_ALPHABET = 2048


def _place(j: np.ndarray, s: np.ndarray, sa: np.ndarray, pointer: np.ndarray, step: int) -> None:
    """Put suffixes j into the buckets of their first characters, in order,
    upwards from the pointers (step 1) or downwards (step -1)."""
    ch = s[j]
    order = np.argsort(ch, kind="stable")
    ch, j = ch[order], j[order]
    first = np.flatnonzero(np.concatenate([[True], ch[1:] != ch[:-1]]))
    count = np.diff(np.concatenate([first, [len(ch)]]))
    within = np.arange(len(ch)) - np.repeat(first, count)
    at = pointer[ch]
    sa[at + within if step > 0 else at - 1 - within] = j
    pointer[ch[first]] += step * count


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """Suffix array from LMS suffixes in order (or, of their substrings, in
    any order within a bucket)."""
    n = len(s)
    size = np.bincount(s, minlength=k)
    ends = np.cumsum(size)
    starts = ends - size
    sa = np.full(n, -1, np.int64)
    sa[0] = n - 1
    left = starts.copy()
    cut = np.searchsorted(s[lms], np.arange(k + 1))
    chars = np.flatnonzero(size)
    for c in chars.tolist():
        done = int(starts[c])
        if c == 0:
            done = int(left[0])
        while done < left[c]:
            hi = int(left[c])
            j = sa[done:hi] - 1
            done = hi
            j = j[j >= 0]
            j = j[~smaller[j]]
            if len(j):
                _place(j, s, sa, left, 1)
        j = lms[cut[c]:cut[c + 1]] - 1
        j = j[j >= 0]
        j = j[~smaller[j]]
        if len(j):
            _place(j, s, sa, left, 1)
    right = ends.copy()
    for c in chars[::-1].tolist():
        if c == 0:
            break
        done = int(ends[c])
        while right[c] < done:
            lo = int(right[c])
            j = sa[lo:done][::-1] - 1
            done = lo
            j = j[j >= 0]
            j = j[smaller[j]]
            if len(j):
                _place(j, s, sa, right, -1)
        j = sa[starts[c]:left[c]][::-1] - 1
        j = j[j >= 0]
        j = j[smaller[j]]
        if len(j):
            _place(j, s, sa, right, -1)
    return sa


def _doubling(names: np.ndarray) -> np.ndarray:
    """Suffix array by doubling the sorted length."""
    m, h = len(names), 1
    rank = names.astype(np.int64)
    while True:
        key = rank * (m + 1)
        key[:-h or None][:max(m - h, 0)] += rank[h:] + 1
        sa = np.argsort(key, kind="stable")
        sorted_ = key[sa]
        new = np.empty(m, np.int64)
        new[sa] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        rank = new
        if h >= m or rank[sa[-1]] == m - 1:
            return sa
        h *= 2


def _with_sentinel(s: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of s, whose last value is 0 and the only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    # S if the next different character is larger
    differs = np.flatnonzero(s[:-1] != s[1:])
    nxt = differs[np.searchsorted(differs, np.arange(n - 1))]
    smaller = np.concatenate([s[nxt] < s[nxt + 1], [True]])
    is_lms = np.zeros(n, bool)
    is_lms[1:] = smaller[1:] & ~smaller[:-1]
    lms = np.flatnonzero(is_lms)
    by_char = lms[np.argsort(s[lms], kind="stable")]
    sa = _induce(s, smaller, by_char, k)
    order = sa[is_lms[sa]]
    if len(lms) > 1:
        length = np.zeros(n, np.int64)
        length[lms[:-1]] = np.diff(lms) + 1
        length[lms[-1]] = 1
        a, b = order[:-1], order[1:]
        same = length[a] == length[b]
        live, d = np.flatnonzero(same), 0
        while len(live):
            differ = s[a[live] + d] != s[b[live] + d]
            same[live[differ]] = False
            d += 1
            live = live[~differ & (length[a[live]] > d)]
        name = np.empty(n, np.int64)
        name[order] = np.cumsum(np.concatenate([[0], ~same]))
        names = name[lms]
        top = int(names.max()) + 1
        if top < len(lms):
            # the sentinel has name 0 alone, so names end with their own 0
            ranks = _with_sentinel(names, top) if top <= WAVE_ALPHABET else _doubling(names)
            order = lms[ranks]
    return _induce(s, smaller, order, k)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of an array of non-negative integers, sorted;
    a suffix sorts before its extensions."""
    if not len(s):
        return np.zeros(0, np.int64)
    top = int(s.max()) + 2
    kind = np.uint16 if top <= 1 << 16 else np.int64
    t = np.concatenate([s.astype(np.int64) + 1, [0]]).astype(kind)
    return _with_sentinel(t, top)[1:]


def permuted_lcp(b: np.ndarray, sa: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each start i of the bytes ``b`` the common prefix with the suffix
    before it in ``sa``, as far as both stay in their segments; ``left[i]``
    is what is left of i's segment.

    Only irreducible values are compared byte by byte: where the characters
    before i and its neighbour are equal, the value is one less than at
    i - 1."""
    n = len(b)
    if not n:
        return np.zeros(0, np.int64)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    reducible = (phi > 0) & (i > 0)
    r = np.flatnonzero(reducible)
    reducible[r] = (b[r - 1] == b[phi[r] - 1]) & (left[r - 1] == left[r] + 1) & (left[phi[r] - 1] == left[phi[r]] + 1)
    at = np.flatnonzero(~reducible)
    word = np.concatenate([b, np.zeros(8, np.uint8)]).astype(np.uint64)
    for shift in (1, 2, 4):
        word = np.concatenate([word[:-shift] | (word[shift:] << np.uint64(8 * shift)), word[len(word) - shift:]])
    lcp = np.zeros(n, np.int64)
    p, q = at, phi[at]
    cap = np.where(q >= 0, np.minimum(left[p], left[q]), 0)
    live, d = np.flatnonzero(cap > 0), 0
    got = np.zeros(len(at), np.int64)
    while len(live):
        x = word[p[live] + d] ^ word[q[live] + d]
        low = np.bitwise_count(np.where(x == 0, np.uint64(0), (x & (~x + np.uint64(1))) - np.uint64(1))) // 8
        low = np.where(x == 0, 8, low).astype(np.int64)
        got[live] += low
        d += 8
        live = live[(low == 8) & (cap[live] > d)]
    lcp[at] = np.minimum(got, cap)
    # value at i: that of the last irreducible start, less the distance
    last = np.maximum.accumulate(np.where(reducible, 0, i))
    return np.maximum(lcp[last] - (i - last), 0)
