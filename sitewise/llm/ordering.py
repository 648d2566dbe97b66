"""Training-order materialisation: a keyed Feistel permutation gives every
sequence a global slot, and slots are written in order to fixed-stride shards.

Sequences are cut from the token streams of the partitions and numbered
0 .. N-1 (partition totals, summed up, plus the number in the partition).  A
balanced Feistel network permutes the smallest even number of bits that holds
N; slots beyond N are sent through it again (cycle-walking), so the order is
a permutation of 0 .. N-1 that needs no table and no sort of the corpus.
Shard s holds slots s * per_shard and on, each record at (slot - first) *
stride, so a reader can start at any slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import broadcast_if_small, drop, materialise, slices
from .shingles import mix
from .tokens import END, chunk_ids, default_path

ROUNDS = 6


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of indices below n, a permutation of 0 .. n-1 for each key."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + mix(np.array([key % (1 << 64)], np.uint64)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return left << shift | right

    x = once(np.asarray(index, np.uint64))
    while len(out := np.flatnonzero(x >= np.uint64(n))):
        x[out] = once(x[out])
    return x.astype(np.int64)


def record_stride(length: int, id_bytes: int) -> int:
    """Bytes of a record: count (4 bytes), ids, one byte of line end."""
    return 4 + length * id_bytes + 1


def sequences(docs: DataFrame, length: int, path: str) -> DataFrame:
    """docs (doc_id, body binary) -> part, number (in the partition), n,
    record (without the line end), pieces (doc_id, start, length, offset).
    Documents follow each other; only a partition's last sequence is short."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, part = chunk_ids(path), TaskContext.get().partitionId()
        width = memory.dtype.itemsize
        full = length * width
        pad = np.array([END], memory.dtype).tobytes()
        buffer, pieces, number, rows = bytearray(), [], 0, []
        id_type = pa.int64()

        def close() -> tuple:
            n = len(buffer) // width
            body = n.to_bytes(4, "little") + bytes(buffer) + pad * (length - n)
            return part, number, n, body, list(pieces)

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            piece = pa.struct([("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64())])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(piece)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                              ["part", "number", "n", "record", "pieces"])

        for batch in slices(batches):
            id_type = batch.schema.field(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), memory.documents(batch.column(1).to_pylist())):
                at = 0
                while at < len(ids):
                    take = min(full - len(buffer), len(ids) - at)
                    pieces.append({"doc_id": doc, "start": at // width, "length": take // width, "offset": len(buffer) // width})
                    buffer += ids[at:at + take]
                    at += take
                    if len(buffer) == full:
                        rows.append(close())
                        number += 1
                        buffer.clear(), pieces.clear()
                        if len(rows) == 1000:
                            yield flush(rows)
                            rows = []
        memory.forget()
        if buffer:
            rows.append(close())
        if rows:
            yield flush(rows)

    piece = f"struct<doc_id:{kind},start:long,length:long,offset:long>"
    return docs.select("doc_id", "body").mapInArrow(run, f"part long, number long, n long, record binary, pieces array<{piece}>")


def write_order(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, key: int = 1,
                length: int = 2048, per_shard: int = 4096, tokenizer: str | None = None) -> DataFrame:
    """Write all sequences in the order of ``key`` under ``path`` (folders
    shard=N, one file each) and return where each piece of each document is:
    doc_id, start, length, slot, shard, byte (of the record in its shard),
    offset (tokens into the record).

    A document is its ids and the closing id.  The record of a slot is the
    count of its ids (4 bytes, little-endian), ``length`` ids of fixed width,
    padded with the closing id, and a line end.  Defined cases: a null or
    empty text is one closing id; every row is written, repeated or with a
    null id; an empty table writes nothing; other columns are ignored,
    whatever their names.
    """
    tok = tokenizer or default_path()
    body = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    # ids shrink little by snappy; the table, its shuffle and the shards are on disk at once
    seqs = materialise(sequences(body, length, tok), "or-sequences", "zstd")
    parts = seqs.groupBy("part").agg(F.count("*").alias("m"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = materialise(parts.select(F.col("part").alias("bp"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"), "m"), "or-base")
    total = base.agg(F.sum("m")).first()[0] or 0
    placed = seqs.join(broadcast_if_small(base), F.col("part") == F.col("bp")).withColumn("index", F.col("base") + F.col("number"))

    @F.pandas_udf("long")
    def slot_of(index):
        import pandas as pd
        return pd.Series(feistel(index.to_numpy(np.uint64), total, key))

    placed = placed.withColumn("slot", slot_of("index")).withColumn("shard", F.floor(F.col("slot") / per_shard).cast("long"))
    stride = record_stride(length, chunk_ids(tok).dtype.itemsize)
    where = materialise(placed.select("slot", "shard", "pieces"), "or-where")
    # text lines of equal length whose bytes are the records
    (placed.select("shard", "slot", F.col("record").cast("string").alias("value")).repartition("shard")
     .sortWithinPartitions("shard", "slot").select("shard", "value").write.partitionBy("shard").option("lineSep", "\n").text(path))
    drop(seqs)
    return where.select("slot", "shard", F.explode("pieces").alias("p")).select(
        "p.doc_id", "p.start", "p.length", "slot", "shard",
        (F.col("slot") % per_shard * stride).alias("byte"), "p.offset")


def read_order(spark: SparkSession, path: str, first: int, last: int, *, length: int = 2048, per_shard: int = 4096,
               id_bytes: int = 2) -> DataFrame:
    """slot, n, ids (binary) of the slots first .. last - 1; only the shards
    that hold them are read."""
    stride = record_stride(length, id_bytes)
    shards = spark.read.format("binaryFile").load(path).where(
        F.col("shard").between(first // per_shard, (last - 1) // per_shard))
    count = F.floor(F.length("content") / stride)
    rows = shards.select("shard", "content", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).alias("i"))
    rows = rows.withColumn("slot", F.col("shard") * per_shard + F.col("i")).where(F.col("slot").between(first, last - 1))
    record = F.substring("content", (F.col("i") * stride + 1).cast("int"), F.lit(stride - 1))
    rows = rows.select("slot", record.alias("r"))
    return rows.withColumn("n", _little_endian("r")).select(
        "slot", "n", F.substring("r", F.lit(5), (F.col("n") * id_bytes).cast("int")).alias("ids"))


def _little_endian(record: str):
    h = F.hex(F.substring(F.col(record), 1, 4))
    swapped = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in (3, 2, 1, 0)])
    return F.conv(swapped, 16, 10).cast("int")
