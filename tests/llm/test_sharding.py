import hashlib
from collections import Counter, defaultdict

from corpus_data import both, docs, empty, odd  # noqa: F401  (fixtures)
from sitewise.llm.sharding import KEY_BITS, assign_shards, directory, write_shards


def check(docs, limit):
    out = assign_shards(docs, limit).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in out) == Counter(
        (r.doc_id, len((r.text or "").encode())) for r in docs.select("doc_id", "text").collect())
    size, rows = Counter(), Counter()
    for r in out:
        size[r.shard] += r.n_bytes
        rows[r.shard] += 1
        assert r.depth == len(r.shard)
        key = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16)
        assert f"{key:060b}".startswith(r.shard[:KEY_BITS])
    assert all(b <= limit or rows[s] == 1 for s, b in size.items())
    # no bucket inside another, and none split that would have fitted
    up = defaultdict(int)
    for s, b in size.items():
        assert not any(s[:i] in size for i in range(len(s)))
        for i in range(len(s)):
            up[s[:i]] += b
    assert all(b > limit for b in up.values())
    return out


def test_limits(both):
    assert {r.shard for r in check(both, 1 << 30)} == {""}
    for limit in (100_000, 5_000, 100):
        check(both, limit)


def test_one_key_with_most_rows(spark):
    rows = [(7, "x" * 50)] * 300 + [(None, "y" * 20)] * 100 + [(i, "z") for i in range(50)]
    out = check(spark.createDataFrame(rows, "doc_id long, text string"), 1000)
    assert len({r.shard for r in out if r.doc_id == 7}) >= 15


def test_directory_and_files(spark, docs, empty, tmp_path):
    assert assign_shards(empty, 100).count() == 0
    a = assign_shards(docs, 50_000)
    d = directory(a).collect()
    assert sum(r.docs for r in d) == docs.count() and all(r.n_bytes <= 50_000 for r in d)
    write_shards(docs, str(tmp_path / "s"), 50_000)
    back = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "s"))
    assert back.count() == docs.count()


def test_files_of_null_and_repeated_ids(spark, tmp_path):
    rows = [(7, "x" * 50)] * 300 + [(None, "y" * 20)] * 100 + [(i, "z") for i in range(50)] + [(8, None)]
    write_shards(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "s"), 1000)
    back = spark.read.schema("doc_id long, text string, _shard string").parquet(str(tmp_path / "s")).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter(rows)
    size, rows_in = Counter(), Counter()
    for r in back:
        size[r._shard] += len(r.text or "")
        rows_in[r._shard] += 1
    assert all(b <= 1000 or rows_in[s] == 1 for s, b in size.items())
