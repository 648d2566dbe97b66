import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_data import both, docs, odd  # noqa: F401  (fixtures)
import corpus_pipeline
import test_decontam
import test_near_dup
import test_packing
from sitewise.llm.scratch import materialise


SF = "/root/testdata/sf0.001"


def test_stages(spark, both):
    """Each stage against what its rule says of its own input."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = materialise(both.select(*names), "test-docs")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, "/root/testdata/sf0.001"), f"test-{name}")
        assert out.columns == names
        seen[name] = ([tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()])
        docs = out
    before, after = seen["language"]
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert {40, 41, 42, 43, 62} <= gone and len(gone) < 12 and all(r[2] for r in after)
    before, after = seen["lines"]
    assert len(after) < len(before) and sum(len(r[1] or "") for r in after) < sum(len(r[1] or "") for r in before)
    before, after = seen["near_dup"]
    verdict = test_near_dup.expected([r[:2] for r in before])
    assert {r[0] for r in after} == {d for d, _, _, kept in verdict if kept}
    before, after = seen["benchmark"]
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    verdict = test_decontam.expected([r[:2] for r in before], items)
    assert {r[0] for r in after} == {k[0] for k in verdict} - {k[0] for k in verdict if k[-1]}
    test_packing.check(docs)
    pieces = corpus_pipeline.packing(spark, docs, "").collect()
    assert {p.doc_id for p in pieces} == {r[0] for r in after}


def test_rows_without_an_id_of_their_own(spark):
    """Null and shared ids follow the verdict of their own row."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first()["text"]
    long = [" ".join(f"word{(7 * i + 3 * j * j) % 211}" for j in range(90)) for i in range(9)]
    near = long[0].replace("word3 ", "other ", 1)
    rows = [(1, long[0], "a"), (None, long[0], "b"), (None, near, "c"), (None, long[1], "d"), (None, long[1], "e"),
            (5, long[2], "f"), (5, long[3], "g"), (5, bench, "h"), (6, long[4], "i"), (6, long[4], "j"), (9, long[4], "k"),
            (None, bench, "l"), (None, None, "m"), (7, "", "n"), (7, "", "o"), (8, long[3], "p")]
    docs = spark.createDataFrame([(d, t, None, x, x) for d, t, x in rows],
                                 "doc_id long, text string, lang string, out_key string, `a.b` string")
    assert corpus_pipeline.language(spark, docs.limit(0), SF).count() == 0

    def ids(out):
        assert out.columns == docs.columns
        return "".join(sorted(r[3] for r in out.collect()))

    kept = ids(corpus_pipeline.near_dup(spark, docs, SF))
    # of h and l, of d and e, and of i, j and k one stays; b and c go with a, and g with p
    assert len(kept) == 9 and set("afmnopk") <= set(kept) and set(kept) & set("de") and set(kept) & set("hl"), kept
    assert ids(corpus_pipeline.benchmark(spark, docs, SF)) == "abcdefgijkmnop"
    assert corpus_pipeline.near_dup(spark, docs.limit(0), SF).count() == 0
    labelled = docs.withColumn("lang", F.when(F.col("out_key") != "d", F.lit("en")))
    out = corpus_pipeline.language(spark, labelled, SF)
    assert ids(out) == "abcdefghijklp" and {r.lang for r in out.collect()} == {"en"}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.where(F.col("length") <= 0).count() == 0 and out.count() > 100


def test_stages_give_python_short_batches(spark):
    """What a stage writes itself goes to Python in short batches; the
    session's own size holds again afterwards, also after a failure."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    docs = spark.range(0, 5000, numPartitions=1)

    def stage(spark, docs, sf_dir):
        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

        return materialise(docs.mapInArrow(sizes, "n long"), "test-sizes")

    got = [r["n"] for r in corpus_pipeline.frees(stage)(spark, docs, SF).collect()]
    assert sum(got) == 5000 and max(got) <= 1000
    assert spark.conf.get(name) == usual

    def fails(spark, docs, sf_dir):
        raise ValueError("no")

    with pytest.raises(ValueError):
        corpus_pipeline.frees(fails)(spark, docs, SF)
    assert spark.conf.get(name) == usual
