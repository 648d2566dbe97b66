import math
import re
from collections import Counter

import pytest

from corpus_data import both, docs, empty, odd  # noqa: F401  (fixtures)
from sitewise.llm import search as module
from sitewise.llm.search import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(t):
    return TERM.findall((t or "").translate(LOW))


def expected(rows, items, k=10):
    """Every item against every row."""
    tfs = [(d, Counter(terms(t))) for d, t in rows]
    n_docs, total = sum(bool(c) for _, c in tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(x for _, c in tfs for x in c)
    w = {x: math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * n + 1))) for x, n in df.items()}
    asked = {}
    for item, text in set(items):
        if item is not None:
            asked.setdefault(item, Counter()).update(terms(text))
    out = set()
    for item, q in asked.items():
        scored = []
        for d, c in tfs:
            if not c:
                continue
            m = 25 + 75 * sum(c.values()) * n_docs // total
            s = sum(n * w[x] * (10**9 * c[x] // (1000 * c[x] + 8 * m)) for x, n in q.items() if x in c)
            if s > 0:
                scored.append((-s, d is None, d))
        out |= {(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored)[:k])}
    return out


def ask(spark, items):
    return spark.createDataFrame(items, "item_id long, text string, doc_id long, term string, rank int")


ITEMS = [(1, "w1 w2 w3 Wört7é w5"), (1, "w1 w2 w3 Wört7é w5"), (2, None), (3, ""), (4, "nowhere zzz"), (5, "W1 w1 w1 w9"),
         (None, "w1 w2"), (6, "1234 42 !!"), (7, "xy xy one two three"), (8, " ".join(f"w{i}" for i in range(60))), (5, "w11 w12"),
         (9, "naïve tail \U0001f600 it we")]


def result(df):
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_every_document(spark, both):
    rows = [(r.doc_id, r.text) for r in both.select("doc_id", "text").collect()]
    items = ITEMS + [(100 + i, t) for i, (_, t) in enumerate(rows) if t and i % 25 == 0]
    out = search(both, ask(spark, [(*i, 7, "t", 1) for i in items]))
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    got = result(out)
    assert got == expected(rows, items) and len({i for i, *_ in got}) > 10


@pytest.mark.parametrize("aside, octave", [(1.0, 8), (0.0, 1), (0.9, 2)])
def test_settings_change_no_result(spark, docs, monkeypatch, aside, octave):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    monkeypatch.setattr(module, "ASIDE", aside)
    monkeypatch.setattr(module, "PER_OCTAVE", octave)
    monkeypatch.setattr(module, "BITMAP", 4)  # nearly every word passes it
    assert result(search(docs, ask(spark, [(*i, 7, "t", 1) for i in items]))) == expected(rows, items)


def test_shuffled_joins(spark, docs, monkeypatch):
    """The same without any broadcast."""
    items = [(1, "the of and"), (2, docs.first().text)]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    monkeypatch.setattr(module, "broadcast_if_small", lambda df, rows=0: df)
    assert result(search(docs, ask(spark, [(*i, 7, "t", 1) for i in items]))) == expected(rows, items)


def test_ties_and_long_texts(spark):
    rows = [(i, "tie word") for i in range(30)] + [(40, "tie " + "other thing " * 300_000), (41, None), (5, "tie word"), (None, "tie word")]
    items = [(1, "tie"), (2, "other other")]
    got = search(spark.createDataFrame(rows, "doc_id long, text string"), ask(spark, [(*i, 7, "t", 1) for i in items])).collect()
    first = [(r["rank"], r.doc_id) for r in got if r.item_id == 1]
    assert sorted(first) == list(enumerate([0, 1, 2, 3, 4, 5, 5, 6, 7, 8], 1))
    assert {(r.item_id, r["rank"], r.doc_id, r.score) for r in got} == expected(rows, items)


def test_empty(spark, empty, docs):
    no_items = ask(spark, [])
    some = ask(spark, [(1, "the", 1, "t", 1)])
    assert search(empty, some).count() == 0
    assert search(docs, no_items).count() == 0
    assert search(docs, ask(spark, [(1, "zzzz qqqq", 1, "t", 1)])).count() == 0
