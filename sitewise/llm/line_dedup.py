"""Fuzzy line deduplication over the whole corpus, in DataFrame functions
only: SimHash of normalised lines, candidate pairs from pigeonhole blocks,
edit similarity to verify, one occurrence kept of each connected group.

A line's features are its different words of more than three bytes, long
ones cut into pieces by their own characters, so that scripts without blanks
have features too.  (Shorter words are much the same in all lines of a language
and would decide the votes.)  The features fall into ``CLASSES`` classes by their hash, and each class votes for one block
of the SimHash.  A changed word takes a feature out of one class and puts one
into another, so at least CLASSES - 2 blocks stay as they are, whatever the
line's length, and every choice of that many blocks is a join key.  Few words
make weak blocks; a line of fewer than ``FEW`` features takes the halves of its
text as blocks instead: one edit leaves the front or the back half alone.
Either way two lines one word or one edit apart share a key; lines further
apart share one the less, the more blocks their changes touch.

Votes are summed by an aggregate over (line, word) rows: 16 bits of a word's
hash are spread over four longs of four 16-bit lanes for its class, so 64
counts are 16 sums of whole longs.  Equal normalised lines are one class before
anything is paired.  As one edit in ten characters keeps lengths within a
tenth, a bucket of lines with a common key is cut into cells of neighbouring
lengths.  A cell proposes (member, centre) pairs; after each round the verified
links are contracted, and only pairs still in different components are left
for the last, exhaustive round.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import broadcast_if_small, drop, is_empty, materialise

CLASSES = 4  # of the features, a block of 16 bits each
FEW = 12  # features from which on the SimHash makes the keys
BOTH = 3  # more features up to which the halves do as well
LEAST = 4  # bytes of a word that counts
PIECE = 12  # characters a word may have as one feature
LANE = 16  # bits of a vote lane in the aggregate
MOST = (1 << (LANE - 2)) - 1  # features a line may have there
ROUNDS = 2  # rounds of one centre a cell before the exhaustive one


# ASCII that separates words within a line
SEPARATORS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
FIRST = 3 * (FEW + BOTH)  # words of a line that are looked at to see that it has many features


def _words(norm: Column) -> Column:
    """The words that count, with repeats."""
    return F.filter(F.split(norm, " "), lambda w: F.octet_length(w) >= LEAST)


def _pieces(words: Column) -> Column:
    def cut(w: Column) -> Column:
        marked = F.transform(F.split(w, ""), lambda c: F.when(F.pmod(F.xxhash64(c), F.lit(4)) == 0, F.concat(c, F.lit(" "))).otherwise(c))
        return F.trim(F.array_join(marked, ""))

    long = F.transform(F.filter(words, lambda w: F.length(w) > PIECE), cut)
    both = F.concat(F.filter(words, lambda w: F.length(w) <= PIECE), F.split(F.array_join(long, " "), " "))
    return F.array_distinct(F.when(F.exists(words, lambda w: F.length(w) > PIECE), both).otherwise(words))


def pieces(norm: Column) -> Column:
    """Features of a normalised line: its different words of ``LEAST``
    bytes or more, those of more than ``PIECE`` cut behind each character
    whose hash says so."""
    return _pieces(_words(norm))


def n_pieces(norm: Column) -> Column:
    """Number of features, or ``FEW + BOTH`` for that many up to ``MOST``: it
    is enough that the first words show them, and that no line of this length
    has more than ``MOST``."""
    first = F.slice(F.split(norm, " ", FIRST + 1), 1, FIRST)
    known = F.array_distinct(F.filter(first, lambda w: (F.octet_length(w) >= LEAST) & (F.length(w) <= PIECE)))
    many = (F.length(norm) <= MOST) & (F.size(known) >= FEW + BOTH)
    return F.when(many, F.lit(FEW + BOTH)).otherwise(F.size(pieces(norm)))


def _spread(h: Column, shift: int) -> Column:
    """Four bits of h, one in each lane of a long."""
    x = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(15).cast("long"))
    x = x.bitwiseOR(F.shiftleft(x, 30)).bitwiseAND(F.lit(0x0000000300000003).cast("long"))
    return x.bitwiseOR(F.shiftleft(x, 15)).bitwiseAND(F.lit(0x0001000100010001).cast("long"))


def line_blocks(cut: DataFrame, key: list[str]) -> DataFrame:
    """key and s0, s1, ... of the lines (key, pieces): the SimHash block of
    each class, -1 for a class without a feature.  A feature's class is the
    last two bits of its hash, its votes are the 16 bits before."""
    ones = F.lit(0x0001000100010001).cast("long")
    rows = cut.select(*key, F.explode("pieces").alias("w")).select(*key, F.xxhash64("w").alias("h"))
    mine = [F.col("h").bitwiseAND(F.lit(3).cast("long")) == c for c in range(CLASSES)]
    none = F.lit(0).cast("long")
    sums = [F.sum(F.when(mine[c], _spread(F.col("h"), 2 + 4 * f)).otherwise(none)).alias(f"v{c}{f}") for c in range(CLASSES) for f in range(4)]
    votes = rows.groupBy(*key).agg(*[F.count_if(mine[c]).alias(f"n{c}") for c in range(CLASSES)], *sums)
    blocks = []
    for c in range(CLASSES):
        spare = (F.lit(MOST) - F.floor(F.col(f"n{c}") / 2)).cast("long") * ones
        block = none
        for f in range(4):
            block = block.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col(f"v{c}{f}") + spare, LANE - 2).bitwiseAND(ones), f))
        blocks.append(F.when(F.col(f"n{c}") == 0, F.lit(-1).cast("long")).otherwise(block).alias(f"s{c}"))
    return votes.select(*key, *blocks)


def block_keys(blocks: list[Column]) -> Column:
    """Join keys of a SimHash: every choice of all blocks but two, hashed with
    the number of the choice; a choice of empty classes is none."""
    keys = [F.when(F.array_max(F.array(*[(blocks[c] != -1).cast("int") for c in chosen])) == 1, F.xxhash64(F.lit(i), *[blocks[c] for c in chosen]))
            for i, chosen in enumerate(combinations(range(CLASSES), CLASSES - 2))]
    return F.array_compact(F.array(*keys))


def half_keys(norm: Column) -> Column:
    """Join keys of a short line: the front and the back half, of two lengths
    each, as texts one character apart have halves of different length."""
    n = F.length(norm)
    out = []
    for i, half in enumerate([F.floor(n / 2), F.floor((n - 1) / 2)]):
        half = half.cast("int")
        front, back = F.substring(norm, F.lit(1), half), F.substring(norm, n - half + 1, half)
        out += [F.xxhash64(F.lit(-1), half, front), F.xxhash64(F.lit(-2), half, back)]
    return F.array_distinct(F.array(*out))


def similar_text(a: str, b: str, edits_in: int) -> Column:
    """At most one edit in ``edits_in`` characters of the longer text.

    With as many words on either side, the edits word by word are an upper
    bound that is quick to take; only where it is not enough are the whole
    texts aligned."""
    most = f"cast(greatest(length({a}), length({b})) div {edits_in} as int)"
    by_word = (f"aggregate(zip_with(split({a}, ' '), split({b}, ' '), (x, y) -> if(x = y, 0, levenshtein(x, y))), "
               f"0, (n, e) -> n + e)")
    return F.expr(f"case when size(split({a}, ' ')) = size(split({b}, ' ')) and {by_word} <= {most} then true "
                  f"else levenshtein({a}, {b}, {most}) >= 0 end")


def _cells(member: DataFrame, edits_in: int) -> DataFrame:
    """(id, cell, len): a bucket cut by length, so that lengths within one in
    ``edits_in`` of each other meet in a cell: each line is in the band of its
    length and in the next one."""
    band = F.floor(F.log(F.col("len").cast("double")) / (-math.log(1 - 1 / edits_in) * 1.000001)).cast("int")
    cells = F.array(F.xxhash64("bucket", band), F.xxhash64("bucket", band + 1))
    return member.select("id", "len", F.explode(cells).alias("cell"))


def _shared(member: DataFrame, by: str, name: str) -> DataFrame:
    """Members of groups that hold more than one line, each once."""
    several = member.groupBy(by).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    several = materialise(several.select(by), f"{name}-shared")
    kept = materialise(member.join(broadcast_if_small(several), by).distinct(), name)
    drop(several)
    return kept


def line_groups(member: DataFrame, texts: DataFrame, *, edits_in: int = 10) -> DataFrame:
    """member (id, len, bucket) and texts (line, norm), any number of equal
    rows each -> (id, component) of the lines linked to another one."""
    spark = member.sparkSession
    first = _shared(member, "bucket", "ld-members")
    cells = _shared(_cells(first, edits_in), "cell", "ld-cells")
    wanted = materialise(cells.select(F.col("id").alias("line")).distinct(), "ld-wanted")
    text = texts.join(broadcast_if_small(wanted), "line").groupBy("line").agg(F.first("norm").alias("norm"))
    text = materialise(text.withColumnRenamed("line", "id"), "ld-texts")
    drop(first, wanted)
    kind = member.schema["id"].dataType.simpleString()
    edges = spark.createDataFrame([], f"src {kind}, dst {kind}")
    labels, kept = None, []
    close = F.abs(F.col("len") - F.col("len2")) <= F.floor(F.greatest("len", "len2") / edits_in)
    for step in range(ROUNDS + 1):
        now = cells.withColumn("component", F.col("id"))
        if labels is not None:
            now = cells.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
            open_ = now.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
            open_ = materialise(open_.select("cell"), "ld-open")
            now = materialise(now.join(broadcast_if_small(open_), "cell"), "ld-left")
            kept += [open_, now]
        if step < ROUNDS:
            centre = now.groupBy("cell").agg(F.min_by(F.struct("id", "len", "component"), F.xxhash64("id", F.lit(step))).alias("c"))
            other = centre.select("cell", F.col("c.id").alias("id2"), F.col("c.len").alias("len2"), F.col("c.component").alias("component2"))
            pairs = now.join(other, "cell").where((F.col("component") != F.col("component2")) & close)
        else:
            other = now.select("cell", F.col("id").alias("id2"), F.col("len").alias("len2"), F.col("component").alias("component2"))
            pairs = now.join(other, "cell").where((F.col("component") != F.col("component2")) & (F.col("id") < F.col("id2")) & close)
        pairs = materialise(pairs.select(F.least("id", "id2").alias("id"), F.greatest("id", "id2").alias("id2")).distinct(), "ld-pairs")
        found = (pairs.join(text, "id").join(text.select(F.col("id").alias("id2"), F.col("norm").alias("norm2")), "id2")
                 .where(similar_text("norm", "norm2", edits_in)).select(F.col("id").alias("src"), F.col("id2").alias("dst")))
        found = materialise(found, "ld-links")
        drop(pairs)
        kept.append(found)
        if is_empty(found):
            continue
        edges = edges.unionByName(found)
        old, labels = labels, components(edges)
        drop(*([old] if old is not None else []))
    if labels is None:
        labels = edges.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    drop(cells, text, *kept)
    return labels


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, edits_in: int = 10,
                carry: list[str] | None = None) -> DataFrame:
    """Documents without the repeated lines: doc_id, text (cleaned), n_lines,
    n_removed and, if ``carry`` names input columns, those as the struct
    ``rest``; one row per input row.

    Lines are what stands between ``\\n``.  A line is normalised to its words
    (in lower case, separated by ASCII characters other than letters and
    digits) joined by one blank.  Lines are linked if their normalised forms
    are equal, or if they share a join key and at most one edit in
    ``edits_in`` characters turns one form into the other.  Lines one word or
    one edit apart share a key; of others that the edits would allow, some do.
    Of each connected group the first occurrence stays, by (doc_id, hash of the
    text, line number), null ids last.  Defined cases: lines without
    a word always stay; a null text stays null with 0 lines;
    rows equal in id and text are the same occurrence and keep the same
    lines; other columns are ignored, whatever their names.
    """
    rest = [F.struct(*carry).alias("rest")] if carry else []
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *rest).withColumn("th", F.xxhash64("text"))
    rest = ["rest"] if carry else []
    # a whole text at a time, its lines stay apart
    plain = F.regexp_replace(F.lower("text"), SEPARATORS, " ")
    cut = docs.select("doc_id", "th", F.posexplode(F.split(plain, "\n")).alias("pos", "raw"))
    cut = cut.select("doc_id", "th", "pos", F.trim("raw").alias("norm")).where("norm <> ''")
    cut = cut.select("doc_id", "th", "pos", "norm", F.xxhash64("norm").alias("line"), F.length("norm").alias("len"), n_pieces(F.col("norm")).alias("n"))
    cut = materialise(cut, "ld-lines")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "pos")
    key = ["line", "len", "doc_id", "th", "pos"]
    s = [f"s{c}" for c in range(CLASSES)]
    hashed = F.col("n").between(FEW, MOST)
    several = cut.where(hashed).select(*key, _words(F.col("norm")).alias("words"))
    blocks = line_blocks(several.select(*key, _pieces(F.col("words")).alias("pieces")), key)
    plain = cut.where(~hashed).select(*key, *[F.lit(None).cast("long").alias(c) for c in s])
    seen = blocks.unionByName(plain).select("line", "len", place.alias("place"), *s)
    classes = materialise(seen.groupBy("line").agg(F.min("place").alias("place"), F.max("len").alias("len"),
                                                   *[F.max(c).alias(c) for c in s], F.count("*").alias("n")), "ld-classes")
    by_blocks = classes.where("s0 is not null").select(F.col("line").alias("id"), "len", F.explode(block_keys([F.col(c) for c in s])).alias("bucket"))
    # shorter lines have no other line within an edit
    halved = cut.where(~F.col("n").between(FEW + BOTH, MOST) & (F.col("len") >= edits_in))
    by_halves = halved.select(F.col("line").alias("id"), "len", F.explode(half_keys(F.col("norm"))).alias("bucket"))
    labels = line_groups(by_blocks.unionByName(by_halves), cut.select("line", "norm"), edits_in=edits_in)
    grouped = classes.join(labels, classes["line"] == labels["id"]).select("line", "component", "place")
    keeper = grouped.groupBy("component").agg(F.min("place").alias("keep"))
    grouped = grouped.join(keeper, "component").select("line", "keep")
    single = (classes.where("n > 1").join(labels, classes["line"] == labels["id"], "left_anti")
              .select("line", F.col("place").alias("keep")))
    repeated = materialise(grouped.unionByName(single), "ld-repeated")
    gone = (cut.select("doc_id", "th", "pos", "line").join(broadcast_if_small(repeated, 200_000), "line")
            .where(~place.eqNullSafe(F.col("keep"))))
    gone = materialise(gone.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone")), "ld-gone")
    g = broadcast_if_small(gone.select(F.col("doc_id").alias("gid"), F.col("th").alias("gth"), "gone"), 200_000)
    out = docs.join(g, (F.col("th") == F.col("gth")) & F.col("doc_id").eqNullSafe(F.col("gid")), "left")
    out = out.select("doc_id", "text", *rest, F.coalesce(F.split("text", "\n"), F.array().cast("array<string>")).alias("lines"),
                     F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    stay = F.when(F.size("lines") > 0, F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"))
    out = out.select("doc_id", "text", *rest, "lines", "gone", stay.alias("stay"))
    text = F.when(F.size("gone") == 0, F.col("text")).otherwise(
        F.array_join(F.transform("stay", lambda i: F.col("lines")[i]), "\n"))
    drop(cut, classes, labels, repeated)
    return out.select("doc_id", text.alias("text"), F.size("lines").cast("long").alias("n_lines"),
                      F.size("gone").cast("long").alias("n_removed"), *rest)

