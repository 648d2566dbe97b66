"""Extendible hashing into shards within a byte limit, in DataFrame functions
only.

The directory is indexed by the leading bits of a key hash.  Byte sums are
taken once per prefix of some more bits than a balanced directory needs; the
sums of all shorter prefixes follow from that small table.  A bucket is split
on its next bit only while it is over the limit, so a row's shard is its
shortest prefix that fits.  Buckets still over the limit at the deepest bit
of a pass go through another pass of their own, down to ``KEY_BITS``; beyond
those, rows that share a key are split by bits of a row hash, so a key with a
third of all rows is spread as well.  A row larger than the limit stays alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import broadcast_if_small, drop, is_empty, materialise

KEY_BITS = 60  # bits of the key hash; as many of the row hash follow
PASS_BITS = 8


def _md5_bits(c: Column) -> Column:
    """60 leading bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def _prefix(depth: Column | int, key: Column, more: Column) -> Column:
    """The first ``depth`` bits as a string, of the two hashes in a row."""
    bits = F.concat(F.lpad(F.bin(key), KEY_BITS, "0"), F.lpad(F.bin(more), KEY_BITS, "0"))
    return F.substring(bits, F.lit(1), F.lit(depth) if isinstance(depth, int) else depth)


def assign_shards(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text", *,
                  carry: list[str] | None = None) -> DataFrame:
    """Shard of every row: doc_id, n_bytes, shard (its leading hash bits as a
    string of 0 and 1, '' if one shard holds all), depth and, if ``carry``
    names input columns, those as the struct ``rest``; one row per input row.

    Defined cases: a null text has 0 bytes; rows with one id share their
    leading ``KEY_BITS`` bits and so stay together unless they are over the
    limit themselves, null ids like an empty one; equal rows are told apart
    by a row number that is fixed before anything is counted; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    rest = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest")] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), *rest)
    rest = ["rest"] if carry else []
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = materialise(rows.select("doc_id", "n_bytes", *rest, _md5_bits(name).alias("key"),
                                   _md5_bits(F.col("row").cast("string")).alias("more")), "sh-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    step = max(1, (total // limit_bytes).bit_length() + 4)
    depth, todo, parts = 0, rows, []
    while True:
        # open: rows whose bucket of `depth` bits is over the limit (or, at
        # first, all rows as the bucket of no bits)
        deep = min(depth + step, 2 * KEY_BITS)
        cells = todo.groupBy(_prefix(deep, F.col("key"), F.col("more")).alias("cell")).agg(
            F.sum("n_bytes").alias("b"), F.count("*").alias("m"))
        cells = materialise(cells, "sh-cells")
        up = cells.withColumn("d", F.explode(F.sequence(F.lit(depth), F.lit(deep))))
        nodes = up.groupBy("d", F.substring("cell", F.lit(1), F.col("d")).alias("p")).agg(F.sum("b").alias("b"), F.sum("m").alias("m"))
        fits = nodes.where((F.col("b") <= limit_bytes) | (F.col("m") == 1) | (F.col("d") == 2 * KEY_BITS)).select("d", "p")
        leaf = (up.select("cell", "d", F.substring("cell", F.lit(1), F.col("d")).alias("p")).join(fits, ["d", "p"])
                .groupBy("cell").agg(F.min("d").alias("depth")))
        leaf = materialise(cells.select("cell").join(leaf, "cell", "left"), "sh-leaves")
        key = todo.withColumn("cell", _prefix(deep, F.col("key"), F.col("more")))
        placed = key.join(broadcast_if_small(leaf), "cell")
        parts.append(placed.where("depth is not null").select("doc_id", "n_bytes", F.substring("cell", F.lit(1), F.col("depth")).alias("shard"), "depth", *rest))
        drop(cells)
        todo = materialise(placed.where("depth is null").select("doc_id", "n_bytes", *rest, "key", "more"), "sh-open")
        if is_empty(todo):
            break
        depth, step = deep, PASS_BITS
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def directory(assigned: DataFrame) -> DataFrame:
    """The buckets in use: shard, depth, docs, n_bytes."""
    return assigned.groupBy("shard", "depth").agg(F.count("*").alias("docs"), F.sum("n_bytes").alias("n_bytes"))


def write_shards(docs: DataFrame, path: str, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as one folder per shard, every row once: rows with a
    null or a repeated id as well, as each carries its own assignment."""
    at = assign_shards(docs, limit_bytes, id_col, text_col, carry=docs.columns)
    rows = at.select("rest.*", F.col("shard").alias("_shard"))
    rows.repartition("_shard").write.partitionBy("_shard").parquet(path)
