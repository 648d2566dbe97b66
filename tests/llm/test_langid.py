import zlib

import numpy as np
from pyspark.sql import functions as F

from corpus_data import empty, odd  # noqa: F401  (fixtures)
from sitewise.llm.langid import LENGTH, ByteCnn, identify, windows_of


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(out) == docs.count()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in out if r.held_out and r.lang and r.lang_pred != "und"]
    assert len(held) > 100 and np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_odd_rows(odd, empty):
    out = identify(odd, epochs=1)
    rows = out.collect()
    assert len(rows) == odd.count()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {40, 41, 42, 43, 62, None} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert identify(empty).count() == 0
    assert {r.lang_pred for r in identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_labels_and_ids_of_held_out_rows_are_not_seen(odd):
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    other = odd.withColumn("lang", F.when(fold == 2, F.lit("zz")).otherwise(F.col("lang")))
    a = sorted(map(str, identify(odd, epochs=1).collect()))
    assert a == sorted(map(str, identify(other, epochs=1).collect()))


def test_windows_cover_the_text():
    x, size = windows_of(b"abc" * 400)
    assert x.shape == (5, LENGTH) and size.sum() == 1200 and bytes(x.ravel()[:1200]) == b"abc" * 400


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = ByteCnn(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(97, 105, (6, 40)).astype(np.uint8), rng.integers(0, 3, 6)

    def loss():
        net.fuse()
        return -np.log(net.probabilities(x)[np.arange(6), y]).mean()

    g = net.gradients(x, y)
    for name in ("V", "c", "W3", "b4", "W5", "E"):
        flat, grad = net.p[name].ravel(), g[name].ravel()
        for i in np.argsort(-np.abs(grad))[:3].tolist():
            old, step = flat[i], 1e-5
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - grad[i]) < 1e-4
