import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corpus_data import both, docs, empty, odd  # noqa: F401  (fixtures)
from sitewise.llm.packing import Rounds, pack


def whole_ids(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def check(docs, window=4096, **kw):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = defaultdict(list)
    for (d, _), ids in zip(rows, whole_ids([t for _, t in rows])):
        want[d].append(tuple(ids))
    pieces = pack(docs, window=window, **kw).collect()
    # every sequence is gapless from 0, all but the last are full
    seqs = defaultdict(list)
    for p in pieces:
        assert p.length > 0 and len(p.ids) == 4 * p.length
        seqs[p.sequence_id].append((p.offset, p.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for s, parts in seqs.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == window or s == len(seqs) - 1
    # pieces give the documents back
    got = defaultdict(list)
    for p in pieces:
        got[p.doc_id].append((p.doc_tokens, p.start, tuple(np.frombuffer(p.ids, "<u4").tolist())))
    for d, docs_ in want.items():
        if len(docs_) == 1:
            parts = sorted(got[d], key=lambda x: x[1])
            assert tuple(i for p in parts for i in p[2]) == docs_[0]
            assert {p[0] for p in parts} == {len(docs_[0])}
        else:
            assert sum(len(p[2]) for p in got[d]) == sum(map(len, docs_))
    assert set(got) == set(want)
    return pieces


def test_round_trip(both):
    check(both)


def test_small_windows_and_few_queues(odd):
    check(odd, window=64, max_queues=2)


def test_targets_hold_while_sources_last(docs):
    pieces = check(docs, window=1024, targets={"src1": 0.5, "src2": 0.25})
    share = defaultdict(int)
    for p in pieces:
        if p.sequence_id < 10:
            share[p.source] += p.length
    assert abs(share["src1"] / 10240 - 0.5) < 0.02 and abs(share["src2"] / 10240 - 0.25) < 0.02


def test_mixture_of_every_window(docs):
    pieces = check(docs, window=4096, grain=1)
    total, per = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for p in pieces:
        total[p.source] += p.length
        per[p.sequence_id][p.source] += p.length
    n = sum(total.values())
    for s in range(max(per)):
        for k, t in total.items():
            assert abs(per[s][k] - 4096 * t / n) <= len(total) + 2


def test_mixture_with_grains(docs):
    pieces = check(docs)
    total, per = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for p in pieces:
        total[p.source] += p.length
        per[p.sequence_id][p.source] += p.length
    n, sent = sum(total.values()), defaultdict(int)
    for s in range(max(per)):  # what a source is owed at the end of a window stays below a grain
        for k, t in total.items():
            sent[k] += per[s][k]
            assert abs(sent[k] - (s + 1) * 4096 * t / n) <= 64 * 2 + len(total)


def many_sources(spark, n):
    rows = [(i, " ".join(f"word{(i * 7 + j) % 50}" for j in range(150)), f"s{i % n}" if i % n else None) for i in range(2 * n)]
    rows += [(2 * n + i, "some common words of a large source " * 30, "big") for i in range(n // 20)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_sources_beyond_the_queues(spark):
    """3,000 sources for 64 queues: a target in the tail is kept, the others
    go on in proportion to their sizes."""
    pieces = check(many_sources(spark, 3000), max_queues=64, targets={"s17": 0.01, "s2999": 0.02, "absent": 0.3})
    last = max(p.sequence_id for p in pieces)
    total, half, early = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in pieces:
        total[p.source] += p.length
        half[p.source] += p.length if p.sequence_id < last // 2 else 0
        early[p.source] += p.length if p.sequence_id < 4 else 0
    for s, share in (("s17", 0.01), ("s2999", 0.02)):  # to a quantum and a grain, while the source lasts
        assert abs(early[s] - min(share * 4 * 4096, total[s])) <= share * 4096 + 64
    n, cut = sum(total.values()), defaultdict(list)
    for p in pieces:
        cut[p.doc_id, p.doc_tokens].append(p.length)
    for (_, tokens), parts in cut.items():  # whatever the number of sources
        assert len(parts) <= 2 * (tokens / 64 + 2) + tokens / 4096 + 1
    for s, t in total.items():
        if s not in ("s17", "s2999"):
            assert abs(half[s] - t / 2) <= 64 * 3 + 0.02 * t, (s, half[s], t)
    assert n > 1_000_000


def test_empty(empty):
    assert pack(empty).count() == 0


def test_rounds_cover_every_token_once():
    r = Rounds([5, 1000, 37, 0, 400], [5, 1000, 37, 1, 3000], 64)
    seen = np.zeros(1442, int)
    for q, n in enumerate([5, 1000, 37, 0, 400]):
        for x in range(0, n, 100):
            m = min(100, n - x)
            got = list(r.runs(q, x, m, block=3))
            assert sum(k for _, k, _ in got) == m
            for _, k, place in got:
                seen[place:place + k] += 1
    assert (seen == 1).all()


def test_rounds_of_tiny_shares_and_grains():
    for grain in (1, 7, 64):
        totals = [5, 1000, 37, 0, 400, 2000]
        r = Rounds(totals, [5, 1000, 37, 1, 3000, 1e-9], 64, grain)
        seen = np.zeros(sum(totals), int)
        for q, n in enumerate(totals):
            for x in range(0, n, 90):
                for start, k, place in r.runs(q, x, min(90, n - x), block=3):
                    seen[place:place + k] += 1
        assert (seen == 1).all()


def test_rounds_of_very_long_queues():
    n = 10**13  # at the least share this takes 2.6e18 rounds
    r = Rounds([n, n, 10], [1e-9, 1, 1], 4096, 64)
    assert list(r.runs(0, n - 500, 500)) == [(0, 500, 2 * n + 10 - 500)]


def test_crc():
    assert zlib.crc32(np.array([2], "<u4").tobytes()) == zlib.crc32(b"\x02\0\0\0")
