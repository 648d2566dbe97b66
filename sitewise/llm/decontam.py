"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts become word hashes, word hashes become hashes of every run of ``GRAM``
words, and each window of ``window - GRAM + 1`` such runs keeps its smallest
hash.  Two texts that share ``window`` words share the smallest hash of that
span, so a join of the kept fingerprints misses no shared span; density is
about two in ``window - GRAM + 2``.  Documents with a hit are read again and
the hits are extended: every window whose smallest hash is a hit is looked up
among the benchmark windows by hash and compared as text, so a match is
exact.  Benchmark items shorter than a window are looked up by the hash of
their whole length at every document position, behind a fixed-size bitmap.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import broadcast_if_small, drop, materialise

GRAM = 6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BITMAP = 1024  # longs in the bitmap of short items
CANDIDATE_ROWS = 200_000  # rows with hit lists that may be broadcast


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of 0-9, a-z and non-ASCII."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, SEPARATORS), "")


def _ahead(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a), F.lit(1)))


def _zip(a: Column, b: Column, by: int, f) -> Column:
    return F.zip_with(a, _ahead(b, by), f)


def with_grams(df: DataFrame, n: int, out: str) -> DataFrame:
    """Column ``out``: hash of each run of ``n`` words, from the column
    ``_h`` of word hashes, by doubling.  Every step is a column of its own,
    used twice by the next, so no step is evaluated per element."""
    have, cols = {1: "_h"}, ["_h"]
    size = 1
    while size * 2 <= n:
        df = df.withColumn(f"_g{size * 2}", _zip(F.col(have[size]), F.col(have[size]), size, lambda a, b: F.xxhash64(a, b)))
        size *= 2
        have[size] = f"_g{size}"
        cols.append(have[size])
    col, got = have[size], size
    while got < n:
        step = max(s for s in have if s <= n - got)
        df = df.withColumn(f"_g{got + step}", _zip(F.col(col), F.col(have[step]), got, lambda a, b: F.xxhash64(a, b)))
        got += step
        col = f"_g{got}"
        cols.append(col)
    df = df.withColumn(out, F.slice(F.col(col), 1, F.greatest(F.size("_h") - (n - 1), F.lit(0))))
    return df.drop(*[c for c in cols if c != "_h" and c != out])


def with_minima(df: DataFrame, grams: str, window: int, out: str) -> DataFrame:
    """Column ``out``: smallest gram hash of each window of ``window`` words."""
    width, got, col = window - GRAM + 1, 1, grams
    made = []
    while got < width:
        step = min(got, width - got)
        df = df.withColumn(f"_m{got + step}", _zip(F.col(col), F.col(col), step, lambda a, b: F.least(a, b)))
        got += step
        col = f"_m{got}"
        made.append(col)
    df = df.withColumn(out, F.slice(F.col(col), 1, F.greatest(F.size("_h") - (window - 1), F.lit(0))))
    return df.drop(*made)


def _hashed(df: DataFrame, *keep: str) -> DataFrame:
    return (df.select(*keep, F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("_w"))
            .withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))))


def _window_rows(df: DataFrame, starts: Column, n: int, grams: str, keep: list[str]) -> DataFrame:
    """One row per start: s, l, wh (hash), ws (text of the window)."""
    g, w = F.col(grams), F.col("_w")
    rows = df.withColumn("_s", F.explode(starts))
    return rows.select(*keep, F.col("_s").alias("s"), F.lit(n).alias("l"), g[F.col("_s")].alias("wh"),
                       F.array_join(F.slice(w, F.col("_s") + 1, n), " ").alias("ws"))


def _positions(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _in_bitmap(bitmap: Column, h: Column) -> Column:
    word = bitmap[F.pmod(F.shiftright(h, 6), F.lit(BITMAP)).cast("int")]
    return F.getbit(word, F.pmod(h, F.lit(64)).cast("int")) == 1


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", *, window: int = 13,
                  one_in: int = 20) -> DataFrame:
    """Contamination of whole documents by benchmark items: doc_id, n_words,
    n_hit, n_items, items_sha256, contaminated; one row per input row.

    A window is ``window`` consecutive item words; an item with fewer, but
    not none, is one window.  A document word inside any occurrence of a
    window is hit.  contaminated: n_hit > 0 and one_in * n_hit >= n_words.
    Defined cases: null text has no words; null items (text or id) have no
    windows; repeated items and rows count as they are (a repeated row gets
    its own, equal result); an empty benchmark contaminates nothing; other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "th", F.xxhash64("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text")
                             ).where("item_id is not null and text is not null")

    # benchmark: windows with their item sets, fingerprints of full windows
    b = _hashed(items, "item_id").where(F.size("_h") > 0)
    b = materialise(b, "dc-items")
    lengths = sorted(r[0] for r in b.select(F.least(F.size("_h"), F.lit(window)).alias("l")).distinct().collect())
    parts = []
    for n in lengths:
        full = with_grams(b.where((F.size("_h") == n) if n < window else (F.size("_h") >= n)), n, "_gn")
        parts.append(_window_rows(full, _positions(F.size("_gn")), n, "_gn", ["item_id"]))
    empty = spark.createDataFrame([], "item_id string, s int, l int, wh long, ws string")
    wins = empty
    for p in parts:
        wins = wins.unionByName(p)
    wins = (wins.groupBy("l", "wh", "ws").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
            .withColumn("set_id", F.sha2(F.array_join("items", ","), 256)))
    wins = materialise(wins, "dc-windows")
    sets = materialise(wins.groupBy("set_id").agg(F.first("items").alias("items")), "dc-sets")
    marks = with_minima(with_grams(b.where(F.size("_h") >= window), GRAM, "_g"), "_g", window, "_m")
    marks = materialise(marks.select(F.explode("_m").alias("fp")).distinct(), "dc-marks")
    short = [n for n in lengths if n < window]
    bitmap = _short_bitmap(wins.where(F.col("l") < window)) if short else None

    def short_starts(df: DataFrame, n: int) -> tuple[DataFrame, Column]:
        df = with_grams(df, n, f"_short{n}")
        g = F.col(f"_short{n}")
        return df, F.filter(_positions(F.size(g)), lambda i: _in_bitmap(bitmap, g[i]))

    # documents: fingerprints, and whether a short item may be inside
    d = _hashed(docs, "doc_id", "th")
    maybe = F.lit(False)
    for n in short:
        d = with_grams(d, n, f"_short{n}")
        maybe = maybe | F.exists(f"_short{n}", lambda h: _in_bitmap(bitmap, h))
    d = with_minima(with_grams(d, GRAM, "_g"), "_g", window, "_m")
    d = materialise(d.select("doc_id", "th", F.size("_h").cast("long").alias("n_words"),
                             F.array_distinct("_m").alias("fps"), maybe.alias("maybe")), "dc-prints")
    hits = (d.select("doc_id", "th", F.explode("fps").alias("fp")).join(broadcast_if_small(marks), "fp")
            .select("doc_id", "th", "fp"))
    hits = hits.unionByName(d.where("maybe").select("doc_id", "th", F.lit(None).cast("long").alias("fp")))
    hits = materialise(hits.groupBy("doc_id", "th").agg(F.collect_set("fp").alias("hit")), "dc-hits")

    # extension: the windows around hits of the documents that have any
    h = broadcast_if_small(hits.select(F.col("doc_id").alias("hid"), F.col("th").alias("hth"), "hit"), CANDIDATE_ROWS)
    near = docs.join(h, (docs["th"] == F.col("hth")) & docs["doc_id"].eqNullSafe(F.col("hid")))
    near = _hashed(near, "doc_id", "th", "hit")
    e = with_grams(near, window, "_gn")
    e = with_minima(with_grams(e, GRAM, "_g"), "_g", window, "_m")
    starts = F.filter(_positions(F.size("_m")), lambda i: F.array_contains("hit", F.col("_m")[i]))
    found = _window_rows(e, starts, window, "_gn", ["doc_id", "th"])
    for n in short:
        e, starts = short_starts(near, n)
        found = found.unionByName(_window_rows(e, starts, n, f"_short{n}", ["doc_id", "th"]))
    found = found.join(broadcast_if_small(wins.select("l", "wh", "ws", "set_id"), CANDIDATE_ROWS), ["l", "wh", "ws"])
    found = materialise(found.groupBy("doc_id", "th").agg(
        F.array_sort(F.collect_set(F.struct("s", (F.col("s") + F.col("l")).alias("e")))).alias("spans"),
        F.collect_set("set_id").alias("set_ids")), "dc-found")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("spans", start, lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).cast("long").alias("n"),
        F.greatest(a["end"], x["e"]).alias("end")))["n"]
    named = (found.select("doc_id", "th", F.explode("set_ids").alias("set_id"))
             .join(broadcast_if_small(sets, CANDIDATE_ROWS), "set_id")
             .select("doc_id", "th", F.explode("items").alias("item")).groupBy("doc_id", "th")
             .agg(F.array_sort(F.collect_set("item")).alias("items")))
    r = (found.select(F.col("doc_id").alias("rid"), F.col("th").alias("rth"), covered.alias("n_hit"))
         .join(named.withColumnsRenamed({"doc_id": "nid", "th": "nth"}),
               (F.col("rth") == F.col("nth")) & F.col("rid").eqNullSafe(F.col("nid")))
         .select("rid", "rth", "n_hit", "items"))
    out = d.select("doc_id", "th", "n_words").join(
        r, (F.col("th") == F.col("rth")) & F.col("doc_id").eqNullSafe(F.col("rid")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    names = F.coalesce("items", F.array().cast("array<string>"))
    drop(b, marks, hits)
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
                      F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
                      ((n_hit > 0) & (one_in * n_hit >= F.col("n_words"))).alias("contaminated"))


def _short_bitmap(wins: DataFrame) -> Column:
    """Bitmap of the hashes of short items, as a literal of ``BITMAP`` longs
    whatever their number."""
    word = F.pmod(F.shiftright("wh", 6), F.lit(BITMAP)).cast("int")
    bit = F.expr("shiftleft(1L, cast(pmod(wh, 64) as int))")
    got = {r[0]: r[1] for r in wins.groupBy(word.alias("w")).agg(F.bit_or(bit)).collect()}
    return F.lit([got.get(i, 0) for i in range(BITMAP)]).cast("array<long>")
