from collections import Counter

from corpus_data import both, docs, empty, odd  # noqa: F401  (fixtures)
from sitewise.llm.near_dup import near_duplicates, odd_sketch, sketch_limit
from sitewise.llm.components import components


def the_set(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def expected(rows):
    sets = [(d, the_set(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    live = [(d, s) for d, s in sets if d is not None and s]
    for i, (d, s) in enumerate(live):
        for e, r in live[:i]:
            x = len(s & r)
            if 100 * x >= 75 * (len(s) + len(r) - x):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return Counter((d, len(s), None if d is None else find(d), True if d is None else find(d) == d) for d, s in sets)


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_against_all_pairs(both):
    rows = [tuple(r) for r in both.select("doc_id", "text").collect()]
    assert got(near_duplicates(both)) == expected(rows)


def test_small_tiles_change_nothing(odd):
    assert got(near_duplicates(odd, tile=2)) == got(near_duplicates(odd))


def test_empty(empty):
    assert near_duplicates(empty).count() == 0


def test_sketch_limit_keeps_pairs_at_the_threshold():
    import numpy as np
    rng = np.random.default_rng(1)
    worst = 0
    for _ in range(300):
        a = rng.integers(0, 2**32, 160, dtype=np.uint32)
        b = a.copy()
        differ = rng.random(160) < 0.25
        b[differ] = rng.integers(0, 2**32, differ.sum(), dtype=np.uint32)
        worst = max(worst, int(np.bitwise_count(odd_sketch(a) ^ odd_sketch(b)).sum()))
    assert worst <= sketch_limit(160, 0.75)


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (20, 21), (21, 22), (7, 7), (None, 3), (22, 20), (5, 4)] + [(100 + i, 101 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "src long, dst long")
    out = {r[0]: r[1] for r in components(df).collect()}
    assert out == {**{i: 3 for i in (3, 4, 5, 9)}, **{i: 20 for i in (20, 21, 22)}, **{100 + i: 100 for i in range(41)}}
