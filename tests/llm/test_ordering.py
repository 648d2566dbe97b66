from collections import defaultdict

import numpy as np
import pytest

from corpus_data import both, docs, empty, odd  # noqa: F401  (fixtures)
from sitewise.llm.ordering import feistel, read_order, write_order

from test_packing import whole_ids


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_feistel_is_a_keyed_permutation(n):
    a = feistel(np.arange(n), n, 1)
    assert sorted(a.tolist()) == list(range(n))
    if n > 60:
        b = feistel(np.arange(n), n, 2)
        assert (a != b).mean() > 0.8 and (a != np.arange(n)).mean() > 0.8
        # neighbours are spread evenly enough
        assert abs(np.corrcoef(np.arange(n), a)[0, 1]) < 0.3


def test_round_trip(spark, both, tmp_path):
    path = str(tmp_path / "order")
    kw = {"length": 100, "per_shard": 64}
    where = write_order(both, path, key=9, **kw).collect()
    n = max(r.slot for r in where) + 1
    ids = {r.slot: np.frombuffer(r.ids, "<u2") for r in read_order(spark, path, 0, n, **kw).collect()}
    assert sorted(ids) == list(range(n))
    got = defaultdict(list)
    for r in sorted(where, key=lambda r: r.start):
        assert r.byte == r.slot % 64 * (4 + 200 + 1) and r.shard == r.slot // 64
        got[r.doc_id].append((r.start, ids[r.slot][r.offset:r.offset + r.length].tolist()))
    rows = [(r.doc_id, r.text) for r in both.select("doc_id", "text").collect()]
    want = defaultdict(list)
    for (d, _), x in zip(rows, whole_ids([t for _, t in rows])):
        want[d].append(x)
    assert set(got) == set(want)
    for d, texts in want.items():
        if len(texts) == 1:
            assert [i for _, p in got[d] for i in p] == texts[0]
        else:
            assert sum(len(p) for _, p in got[d]) == sum(map(len, texts))
    # resumed in the middle: only what was asked for
    some = read_order(spark, path, 70, 130, **kw).collect()
    assert sorted(r.slot for r in some) == list(range(70, min(130, n)))


def test_same_key_same_order_and_empty(odd, empty, tmp_path):
    a = sorted(map(str, write_order(odd, str(tmp_path / "a"), key=3, length=64, per_shard=8).collect()))
    assert a == sorted(map(str, write_order(odd, str(tmp_path / "b"), key=3, length=64, per_shard=8).collect()))
    assert a != sorted(map(str, write_order(odd, str(tmp_path / "c"), key=4, length=64, per_shard=8).collect()))
    assert write_order(empty, str(tmp_path / "d")).count() == 0


def test_sequences_wait_compressed_for_their_order(spark):
    """The table of the sequences, its shuffle and the shards are on disk at
    once; a table can be written with a codec of its own."""
    import glob

    from sitewise.llm.scratch import drop, materialise
    made = materialise(spark.range(1000).selectExpr("id", "cast('abc' as binary) b"), "codec", "zstd")
    files = [f for f in glob.glob(made._scratch_path.removeprefix("file:") + "/*.parquet")]
    assert files and all(f.endswith(".zstd.parquet") for f in files) and made.count() == 1000
    drop(made)
