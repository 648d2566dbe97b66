import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from corpus_data import both, docs, empty, odd  # noqa: F401  (fixtures)
from sitewise.llm.decontam import GRAM, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def expected(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is None or not w:
            continue
        n = min(13, len(w))
        for i in range(len(w) - n + 1):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = Counter()
    for d, t in rows:
        w = words(t)
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i:i + n])) in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[k]
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out[d, len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


def check(docs, bench):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    got = Counter(tuple(r) for r in decontaminate(docs, bench).collect())
    assert got == expected(rows, items)


def test_table_and_odd_items(spark, both, odd):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    texts = {r.doc_id: r.text for r in odd.collect()}
    passage = texts[61]
    own = [(2000, passage), (2001, passage), (2002, " ".join(passage.split()[5:18])), (2003, "one TWO, three"), (2004, "a"),
           (2005, None), (2006, ""), (2007, "!!"), (None, passage), (2000, passage), (2008, "ab ab ab ab ab ab ab ab"),
           (2009, " ".join(passage.split()[30:42])), (2010, "no such words here"), (2011, texts[56])]
    bench = bench.withColumn("item_id", F.col("item_id").cast("long")).unionByName(
        spark.createDataFrame(own, "item_id long, text string"), allowMissingColumns=True)
    check(both, bench)


def test_empty_sides(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    check(odd, none)
    assert decontaminate(empty, spark.createDataFrame([(1, "some words here")], "item_id long, text string")).count() == 0


def test_window_guarantee():
    # a window of 13 words holds a whole window of grams
    assert 13 - GRAM + 1 >= 1
