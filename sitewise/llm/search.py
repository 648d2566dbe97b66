"""Exact ranked lexical search of many queries at once, in DataFrame functions
only: the ten best documents of each item under an integer BM25.

A score is the inner product of an item's weights with a document's impact
vector, whose coordinates are tf saturated by length.  Documents become
vectors in one pass over the texts, each inside its own row (sorted words, run
lengths), over the words the items have; a bitmap of those words as a literal
keeps the others out.  The vectors are put in buckets by their length.

1. Seeds: the documents with an item's rarest words, scored in full.  The
   tenth best score of an item is a floor ``theta`` that its results reach.
2. Per item and bucket, the words with the smallest possible contributions
   are set aside as long as what they can add stays below a share of theta: by
   Cauchy-Schwarz with the bucket's greatest length, or by the bucket's
   greatest coordinates.  If all words are set aside, the bucket is pruned.
3. Only the words left, the focus, are looked up in the bucket.  A document
   goes on if its score there and a bound of the rest, from the part of its
   length that the focus does not explain, reach theta.
4. The ten best of these on the focus, scored in full, raise theta; those
   whose bound reaches it are scored in full, in 64-bit integers.

Bounds are never below the score, so no result is lost; an item with fewer
than ten seeds has theta 0 and looks up all its words.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decontam import SEPARATORS, words
from .scratch import broadcast_if_small, drop, materialise

BITMAP = 4096  # longs
PER_OCTAVE = 2  # buckets a doubling of the vectors' length
ASIDE = 0.5  # share of theta that the words not looked up may add; saves full scores, changes no result
ROUNDING = 1 + 1e-9  # of the bounds in doubles
BROADCAST_ROWS = 1_000_000  # of a few numbers and one word each


def cut(text: Column) -> Column:
    return F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), SEPARATORS)


def word_bitmap(vocabulary: DataFrame) -> Column:
    """Bitmap of the hashes of ``term``, a literal of ``BITMAP`` longs."""
    h = F.xxhash64("term")
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(term), 64) as int))")
    got = {r[0]: r[1] for r in vocabulary.groupBy(F.pmod(F.shiftright(h, 6), F.lit(BITMAP)).cast("int")).agg(F.bit_or(bit)).collect()}
    return F.split(F.lit(",".join(str(got.get(i, 0)) for i in range(BITMAP))), ",").cast("array<bigint>")


def in_bitmap(bitmap: Column, h: Column) -> Column:
    return F.getbit(bitmap[F.pmod(F.shiftright(h, 6), F.lit(BITMAP)).cast("int")], F.pmod(h, F.lit(64)).cast("int")) == 1


def term_counts(docs: DataFrame, bitmap: Column) -> DataFrame:
    """docs (doc_id, text) -> row, doc_id, n (words), vec (term, tf) over the
    bitmap's words.  Each step is a column that the next uses more than once,
    so that none is evaluated per element.  Cutting leaves an empty string at
    either end of a text that has separators there."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", cut(F.col("text")).alias("_w"))
    ends = [F.when(F.get("_w", F.lit(0)) == "", 1).otherwise(0),
            F.when((F.size("_w") > 1) & (F.get("_w", F.size("_w") - 1) == ""), 1).otherwise(0)]
    d = d.select("row", "doc_id", F.when(F.col("_w").isNull(), 0).otherwise(F.size("_w") - ends[0] - ends[1]).cast("long").alias("n"),
                 F.sort_array(F.filter("_w", lambda w: in_bitmap(bitmap, F.xxhash64(w)))).alias("_s"))
    at = F.when(F.size("_s") > 0, F.sequence(F.lit(0), F.size("_s") - 1)).otherwise(F.array().cast("array<int>"))
    first = F.filter(at, lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)))
    d = d.select("row", "doc_id", "n", "_s", first.alias("_i"))
    run = F.transform("_i", lambda s, j: F.struct(F.get("_s", s).alias("term"),
                                                  (F.coalesce(F.get("_i", j + 1), F.size("_s")) - s).alias("tf")))
    return d.select("row", "doc_id", "n", run.alias("vec"))


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, term, qtf) of the distinct items."""
    i = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null").distinct()
    return i.select("item_id", F.explode(words(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("qtf"))


def postings(counts: DataFrame, vocabulary: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Impact vectors by coordinate: row, doc_id, bucket, norm2 (squared
    length), term, x (impact)."""
    m = F.expr(f"25L + (75L * n * {n_docs}L) div {max(n_terms, 1)}L")
    v = counts.where(F.size("vec") > 0).select("row", "doc_id", m.alias("m"), "vec")
    v = v.select("row", "doc_id", F.expr("transform(vec, v -> struct(v.term as term, (1000000000L * v.tf) div (1000L * v.tf + 8L * m) as x))").alias("vec"))
    norm2 = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v["x"].cast("double") * v["x"].cast("double"))
    v = v.select("row", "doc_id", norm2.alias("norm2"), "vec")
    bucket = F.floor(F.log2(F.col("norm2") + 1) / 2 * PER_OCTAVE).cast("int")
    # a column beside a generator would be worked out for each row of it
    v = v.select("row", "doc_id", "norm2", bucket.alias("bucket"), "vec").where("bucket >= 0")
    v = v.select("row", "doc_id", "bucket", "norm2", F.explode("vec").alias("_v"))
    return v.select("row", "doc_id", "bucket", "norm2", "_v.term", "_v.x").join(broadcast_if_small(vocabulary), "term")


def coordinates(p: DataFrame) -> DataFrame:
    """Per bucket and word: documents, greatest coordinate, greatest length."""
    return p.groupBy("bucket", "term").agg(F.count("*").alias("docs"), F.max("x").alias("top"), F.max("norm2").alias("longest2"))


def weights(terms: DataFrame, coords: DataFrame, n_docs: int) -> DataFrame:
    """(item_id, term, df, q): an item's coordinates, those above 0."""
    df = coords.groupBy("term").agg(F.sum("docs").alias("df"))
    w = F.floor(1000 * F.log((2.0 * F.lit(n_docs) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    return terms.join(df, "term").withColumn("q", w * F.col("qtf")).where("q > 0").select("item_id", "term", "df", "q")


def best(scored: DataFrame, k: int, tie: list[str]) -> DataFrame:
    """The ``k`` highest scores of each item with their rank."""
    by = Window.partitionBy("item_id").orderBy(F.col("score").desc(), *tie)
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def full_scores(pairs: DataFrame, p: DataFrame, q: DataFrame) -> DataFrame:
    """(item_id, row, doc_id, score) of the pairs (item_id, row)."""
    hits = p.select("row", "doc_id", "term", "x").join(broadcast_if_small(pairs, BROADCAST_ROWS), "row")
    hits = hits.join(broadcast_if_small(q.select("item_id", "term", "q"), BROADCAST_ROWS), ["item_id", "term"])
    return hits.groupBy("item_id", "row").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("q") * F.col("x")).alias("score"))


def kth_best(pairs: DataFrame, p: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """(item_id, theta): the least full score among ``k`` documents of an
    item; items with fewer have none."""
    done = full_scores(pairs, p, q).groupBy("item_id").agg(F.count("*").alias("n"), F.min("score").alias("theta"))
    return done.where(F.col("n") >= k).select("item_id", "theta")


def seeds(q: DataFrame, k: int) -> DataFrame:
    """The heaviest words of each item, as many as have ``k`` documents
    among them for sure (a document may have all of them)."""
    by = Window.partitionBy("item_id").orderBy(F.col("q").desc(), "term")
    s = q.withColumns({"_no": F.row_number().over(by), "_sum": F.sum("df").over(by.rowsBetween(Window.unboundedPreceding, -1))})
    return s.where((F.col("_no") == 1) | (F.col("_sum") < k * (F.col("_no") - 1))).select("item_id", "term", "q")


def floors(q: DataFrame, p: DataFrame, k: int) -> DataFrame:
    """(item_id, theta) by the ``k`` documents of an item that score best on
    its seeds alone."""
    s = p.select("row", "term", "x").join(broadcast_if_small(seeds(q, k), BROADCAST_ROWS), "term")
    part = s.groupBy("item_id", "row").agg(F.sum(F.col("q") * F.col("x")).alias("score"))
    pairs = materialise(best(part, k, ["row"]).select("item_id", "row"), "ls-seeds")
    theta = materialise(kth_best(pairs, p, q, k), "ls-floors")
    drop(pairs)
    return theta


def focus(q: DataFrame, coords: DataFrame, theta: DataFrame) -> DataFrame:
    """Per item and bucket the words to look up, with the greatest sum that
    the others can add (rest) and their squared weights (rest2)."""
    t = q.join(coords, "term").join(theta, "item_id", "left").withColumn("theta", F.coalesce("theta", F.lit(0).cast("long")))
    both = ["item_id", "bucket"]
    by = Window.partitionBy(*both).orderBy(F.col("q") * F.col("top"), "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns({"_sum": F.sum(F.col("q") * F.col("top")).over(by),
                       "_sum2": F.sum(F.col("q").cast("double") * F.col("q")).over(by),
                       "_longest2": F.max("longest2").over(Window.partitionBy(*both))})
    bound = F.least(F.col("_sum").cast("double"), F.sqrt(F.col("_sum2") * F.col("_longest2"))) * ROUNDING
    t = t.withColumn("_aside", bound < ASIDE * F.col("theta"))
    whole = Window.partitionBy(*both)
    t = t.withColumns({"rest": F.coalesce(F.max(F.when(F.col("_aside"), F.col("_sum"))).over(whole), F.lit(0)),
                       "rest2": F.coalesce(F.max(F.when(F.col("_aside"), F.col("_sum2"))).over(whole), F.lit(0.0))})
    return t.where(~F.col("_aside")).select(*both, "term", "q", "theta", "rest", "rest2")


def candidates(p: DataFrame, plan: DataFrame) -> DataFrame:
    """(item_id, row, have, most): documents whose bound ``most`` reaches the
    item's floor; ``have`` is their score on the focus."""
    look = broadcast_if_small(plan.select("bucket", "term", "item_id", "q"), BROADCAST_ROWS)
    s = p.select("row", "bucket", "norm2", "term", "x").join(look, ["bucket", "term"])
    x = F.col("x")
    s = s.groupBy("item_id", "row").agg(F.sum(F.col("q") * x).alias("have"), F.sum(x.cast("double") * x).alias("seen2"),
                                        F.max("norm2").alias("norm2"), F.max("bucket").alias("bucket"))
    per = plan.select("item_id", "bucket", "theta", "rest", "rest2").distinct()
    s = s.join(broadcast_if_small(per), ["item_id", "bucket"])
    left2 = F.greatest(F.col("norm2") * ROUNDING - F.col("seen2"), F.lit(0.0))
    rest = F.least(F.col("rest").cast("double"), F.sqrt(F.col("rest2") * left2)) * ROUNDING
    s = s.select("item_id", "row", "have", (F.col("have") + rest).alias("most"), "theta")
    return s.where(F.col("most") >= F.col("theta")).select("item_id", "row", "have", "most")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", *, k: int = 10) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: item_id, rank (from
    1), doc_id, score.

    Terms are runs of letters, digits and non-ASCII characters, A-Z in lower
    case.  With N documents that have a term, L terms in all, n in a document
    and df documents that have a term, the weight of a term is
    floor(1000 ln((2N + 2) / (2df + 1))); a document's m is
    25 + (75 n N) div L, and its score sums weight * ((10^9 tf) div
    (1000 tf + 8 m)) over the item's terms, repeats included.  Only scores
    above 0 count; equal ones go by doc_id, null ids last.  Defined cases:
    null and empty texts have no terms; an item without a match has no rows;
    items without an id are left out, equal items count once, and texts that
    share an item id are one item; every document row is ranked on its own, so
    equal rows take several ranks; empty tables give an empty result; other
    columns are ignored, whatever their names.
    """
    terms = materialise(item_terms(items, item_col, item_text_col), "ls-items")
    vocabulary = materialise(terms.select("term").distinct(), "ls-vocabulary")
    counts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = materialise(term_counts(counts, word_bitmap(vocabulary)), "ls-counts")
    n_docs, n_terms = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    p = materialise(postings(counts, vocabulary, n_docs, n_terms), "ls-postings")
    drop(counts, vocabulary)
    coords = materialise(coordinates(p), "ls-coordinates")
    q = materialise(weights(terms, coords, n_docs), "ls-weights")
    theta = floors(q, p, k)
    plan = materialise(focus(q, coords, theta), "ls-focus")
    found = materialise(candidates(p, plan), "ls-candidates")
    # the best of the candidates so far raise the floor for the others
    top = materialise(best(found.withColumnRenamed("have", "score"), k, ["row"]).select("item_id", "row"), "ls-top")
    higher = materialise(kth_best(top, p, q, k), "ls-higher")
    left = found.join(broadcast_if_small(higher), "item_id", "left").where(F.col("theta").isNull() | (F.col("most") >= F.col("theta")))
    left = materialise(left.select("item_id", "row"), "ls-survivors")
    tie = [F.col("doc_id").asc_nulls_last(), "row"]
    out = best(full_scores(left, p, q).where("score > 0"), k, tie)
    out = materialise(out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ls-result")
    drop(terms, p, coords, q, theta, plan, found, top, higher, left)
    return out
