import random
from collections import Counter

import numpy as np
import pytest

from corpus_data import both, docs, empty, odd  # noqa: F401  (fixtures)
from sitewise.llm import induced
from sitewise.llm.suffix_dedup import remove_repeats


def expected(rows):
    """Every 100-byte string in order of (id, start); rows equal in id and
    text are one document."""
    ordered = sorted({(d, (t or "").encode()) for d, t in rows if d is not None}, key=lambda r: r[0])
    ids = Counter(d for d, _ in ordered)
    assert max(ids.values()) == 1
    seen, out = {}, {}
    for d, b in ordered:
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            s = b[i:i + 100]
            if s in seen:
                gone[i:i + 100] = b"\1" * 100
            else:
                seen[s] = True
        runs = bytes(gone).split(b"\0")
        out[d] = (len(b), sum(gone), sum(bool(r) for r in runs), bytes(x for x, g in zip(b, gone) if not g))
    return Counter((d, *out[d]) for d, _ in rows)


def got(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


def clean(df):
    """Without null ids and ids of several texts."""
    return df.where("doc_id is not null and doc_id <> 60")


def test_against_every_string(both):
    d = clean(both)
    assert got(remove_repeats(d)) == expected([tuple(r) for r in d.select("doc_id", "text").collect()])


def test_hot_anchors_and_small_shards(both):
    d = clean(both)
    plain = got(remove_repeats(d))
    assert got(remove_repeats(d, hot_runs=2, shard_bytes=2000)) == plain
    assert got(remove_repeats(d, bitmap_words=4)) == plain  # by a join instead


def test_null_and_shared_ids(odd, empty):
    out = remove_repeats(odd).collect()
    assert len(out) == odd.count()
    assert all(r.n_removed == 0 for r in out if r.doc_id == 60)
    base = next(r for r in out if r.doc_id == 1)
    assert base.n_removed == 0
    # a null id comes last: its copy of document 1 goes
    assert sorted(r.n_removed for r in out if r.doc_id is None)[-1] == base.n_bytes
    assert remove_repeats(empty).count() == 0


@pytest.mark.parametrize("wave", [2, 4, 2048])
def test_suffix_array(wave, monkeypatch):
    monkeypatch.setattr(induced, "WAVE_ALPHABET", wave)
    rng = random.Random(wave)
    for _ in range(400):
        k, n = rng.choice([1, 2, 3, 250]), rng.randint(1, 50)
        s = np.array([rng.randrange(k) for _ in range(n)], np.uint8)
        if rng.random() < 0.3:
            s = np.tile(s[:rng.randint(1, 5)], 12)[:n]
            n = len(s)
        sa = induced.suffix_array(s)
        assert sa.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        left = np.arange(n, 0, -1)
        lcp = induced.permuted_lcp(s, sa, left)
        for i, j in zip(sa[1:].tolist(), sa[:-1].tolist()):
            m = 0
            while max(i, j) + m < n and s[i + m] == s[j + m]:
                m += 1
            assert lcp[i] == m
    assert len(induced.suffix_array(np.zeros(0, np.uint8))) == 0
