import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from corpus_data import both, docs, empty, odd  # noqa: F401  (fixtures)
from sitewise.llm.resample import Crc, Features, bucket_counts, ranked, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, buckets=10_000):
    w = WORD.findall((text or "").translate(LOW))
    runs = [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    return len(w), [zlib.crc32(r.encode()) % buckets for r in runs]


def expected(rows, target):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (S + 10000)) / ((s[b] + 1) * (T + 10000)))) for b in s}
    out, fit = [], []
    for i, (d, text) in enumerate(rows):
        n, f = features(text)
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, n, len(f), weight, score, None])
        if n >= 20:
            fit.append((-score, d is None, d or 0, len(f), i))
    for rank, (*_, i) in enumerate(sorted(fit)[:5 * len(fit) // 100], 1):
        out[i][5] = rank
    return Counter(map(tuple, out))


def test_resample_against_plain_counts(spark, both):
    rows = [(r.doc_id, r.text) for r in both.select("doc_id", "text").collect()]
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").withColumnRenamed("text", "t")
    texts = [r.t for r in target.collect()] + [None, "", "!!"]
    more = target.select("t").unionByName(spark.createDataFrame([(None,), ("",), ("!!",)], "t string"))
    out = resample(both, more, target_text="t")
    got = out.collect()
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got)) == expected(rows, texts)
    drawn = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert drawn == list(range(1, len(drawn) + 1)) and len(drawn) > 5


def test_crc_of_joined_strings():
    crc, rng = Crc(), np.random.default_rng(1)
    parts = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in zip(rng.integers(0, 40, 200), [0, 1, 63, 64, 65, 127, 128, 1000, 70_001] * 23)]
    a = np.array([zlib.crc32(x) for x, _ in parts], np.uint32)
    b = np.array([zlib.crc32(y) for _, y in parts], np.uint32)
    got = crc.move(a, np.array([len(y) for _, y in parts])) ^ b
    assert got.tolist() == [zlib.crc32(x + y) for x, y in parts]


def test_batches_and_pieces_change_no_count(odd):
    """Texts cut into pieces of a few bytes, and words forgotten between
    calls, against one call."""
    texts = [t.encode() if t is not None else None for t in
             [r.text for r in odd.select("text").collect()] + ["a\0b c\0\0d e f", "\0", "B" * 300 + " tail end", "é" * 70 + " " + "x y " * 50]]
    want = [Counter(features(t.decode() if t is not None else None)[1]) for t in texts]
    gain = np.arange(10_000)
    for size in (1, 7, 64, 1000, 1 << 20):
        f = Features(10_000, call_bytes=size)
        f.words.limit = 50
        assert f.count(texts).tolist() == [sum(w[b] for w in want) for b in range(10_000)]
        n_words, n_features, weight = f.weigh(texts, gain)
        assert n_words.tolist() == [features(t.decode() if t is not None else None)[0] for t in texts]
        assert n_features.tolist() == [sum(w.values()) for w in want]
        assert weight.tolist() == [sum(b * n for b, n in w.items()) for w in want]


def test_very_long_text(spark):
    text = " ".join(f"w{i % 997} x{i % 1009}" for i in range(250_000))  # 2.9 MB
    df = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
    got = {r.bucket: r.n for r in bucket_counts(df).collect()}
    assert got == Counter(features(text)[1] + features("a b")[1])


def test_rank_over_many_partitions(spark):
    df = spark.range(20_000, numPartitions=16).selectExpr("id", "id % 7 as score")
    got = {r.id: r["rank"] for r in ranked(df, df["score"].desc(), df["id"]).collect()}
    want = sorted(range(20_000), key=lambda i: (-(i % 7), i))
    assert got == {i: n for n, i in enumerate(want, 1)}


def test_empty(spark, empty, docs):
    assert resample(empty, empty).count() == 0
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, resample(docs, empty).collect())) == expected(rows, [])
