"""Repeated 100-byte strings by sharded suffix arrays (induced sorting and
permuted common prefixes, ``induced.py``).

A suffix array over all texts would sort mostly bytes that occur once.  Here
every 100-byte string is sent to the shard its bytes choose: winnowing gives
each string one anchor (its smallest 32-byte hash), equal strings have equal
anchors, and strings with one anchor at one place are a run of starts.
Texts are read twice: first to count anchors, then to keep the runs whose
anchor occurs again (by a bitmap of fixed size, which lets a few others pass).
Equal runs are one class, of which all but the earliest are covered at once.
Only anchors with several different runs are left: their bytes go to shards,
each shard's suffix array brings equal strings together, and all but the
earliest of each group are covered.  An anchor with more runs than a shard
takes is split by the strings themselves: the earliest of each string is found
by an aggregate and the others join it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import SPAN, anchors, gram_hashes
from .induced import permuted_lcp, suffix_array
from .scratch import broadcast_if_small, drop, materialise, slices
from .shingles import _M2, mix

K = 32
BITMAP_WORDS = 1 << 18
BROADCAST = 100_000  # rows a broadcast may have here
SHARD_BYTES = 1 << 19
HOT_RUNS = 8192  # runs of one anchor that still fit a shard
LAST = (1 << 63) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (the id as order key, null last), th (31 bits of the text's hash,
    for rows that share an id), body."""
    return docs.withColumns({
        "doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "t1": F.xxhash64("body"),
        "t2": F.xxhash64(F.lit(7), "body")}).withColumn("th", F.shiftrightunsigned("t1", 33))


def _counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [h for b in batch.column(0).to_pylist() if b is not None for h, *_ in anchors(b, K)]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])
    return docs.select("body").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _bitmap(repeated: DataFrame, words: int) -> np.ndarray:
    """Bitmap of fixed size of the anchors that occur again."""
    word = F.shiftrightunsigned("h", 38).bitwiseAND(F.lit(words - 1))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 32) & 63 as int))")
    rows = repeated.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).toPandas()
    out = np.zeros(words, np.uint64)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).view(np.uint64)
    return out


def _runs(docs: DataFrame, bitmap) -> DataFrame:
    """docs (doc, th, body) -> h, c (hash of the run's bytes), doc, pos (th
    and the first start), n (starts), for anchors in the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in slices(batches):
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for doc, th, b in zip(*[c.to_pylist() for c in batch.columns]):
                for h, c, lo, _, n in anchors(b or b"", K):
                    w = bits[(h >> np.uint64(38)) & np.uint64(len(bits) - 1)]
                    ok = (w >> ((h >> np.uint64(32)) & np.uint64(63)) & np.uint64(1)).astype(bool)
                    if ok.any():
                        for col, x in zip(cols, (h[ok].view(np.int64), c[ok].view(np.int64),
                                                 np.full(ok.sum(), doc), lo[ok] + (th << 32), n[ok])):
                            col.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["h", "c", "doc", "pos", "n"])
    return docs.select("doc", "th", "body").mapInArrow(run, "h long, c long, doc long, pos long, n long")


def _window_hashes(b: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    g = gram_hashes(np.frombuffer(b, np.uint8), K)
    x = np.full(n, _M2)
    y = np.full(n, np.uint64(3))
    for d in (*range(0, SPAN - K, K), SPAN - K):
        x = mix(x * _M2 + g[d:d + n])
        y = mix(y + g[d:d + n] * np.uint64(0xD6E8FEB86659FD93))
    return x.view(np.int64), y.view(np.int64)


def _among(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The documents that are (left_semi) or are not (left_anti) among rows
    of a table keyed alike: only ids are broadcast, and only what is left of
    the texts is shuffled by a join that follows."""
    return docs.join(broadcast_if_small(materialise(rows.select("doc", "th"), "sd-ids"), BROADCAST), ["doc", "th"], how)


def _bytes_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of runs: wanted (doc, th, runs array of h, k, lo, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "k", "doc", "pos", "n", "bytes"]
        for batch in slices(batches):
            rows = [(r["h"], r["k"], doc, (th << 32) + r["lo"], r["n"], body[r["lo"]:r["lo"] + r["n"] + SPAN - 1])
                    for doc, th, body, runs in zip(*[c.to_pylist() for c in batch.columns]) for r in runs]
            for i in range(0, len(rows), 50_000):
                cols = list(zip(*rows[i:i + 50_000]))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.binary())], names)

    joined = _among(docs.select("doc", "th", "body"), wanted, "left_semi").join(wanted, ["doc", "th"])
    return joined.select("doc", "th", "body", "runs").mapInArrow(run, "h long, k long, doc long, pos long, n long, bytes binary")


def covered_starts(doc: np.ndarray, pos: np.ndarray, n: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of one shard's runs, the starts whose string also starts earlier in
    the shard, as (doc, pos, n) of runs of starts."""
    size = np.array([len(p) for p in pieces])
    # pieces are separated by one byte; no string reaches into it
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    begin = np.cumsum(size + 1) - (size + 1)
    left = np.repeat(begin + size, size + 1) - np.arange(len(text))
    sa = suffix_array(text)
    lcp = permuted_lcp(text, sa, left)
    # order of starts: document, then position
    ids, rank = np.unique(np.stack([doc, pos >> 32], 1), axis=0, return_inverse=True)
    base = (rank.ravel().astype(np.int64) << 32) + (pos & 0xFFFFFFFF)
    key = np.repeat(base - begin, size + 1) + np.arange(len(text))
    group = np.flatnonzero(np.concatenate([[True], lcp[sa[1:]] < SPAN]))
    earliest = np.minimum.reduceat(key[sa], group)
    later = np.empty(len(text), bool)
    later[sa] = key[sa] != np.repeat(earliest, np.diff(np.append(group, len(sa))))
    later &= left >= SPAN
    edge = np.diff(np.concatenate([[0], later.astype(np.int8), [0]]))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.searchsorted(begin, lo, "right") - 1
    return doc[piece], pos[piece] + lo - begin[piece], hi - lo


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    got = covered_starts(rows["doc"].to_numpy(np.int64), rows["pos"].to_numpy(np.int64), rows["n"].to_numpy(np.int64),
                         [bytes(b) for b in rows["bytes"]])
    return pd.DataFrame(dict(zip(("doc", "pos", "n"), got)))


def _split_hot(pieces: DataFrame) -> DataFrame:
    """Runs of anchors too frequent for a shard, string by string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for doc, pos, n, b in zip(*[c.to_pylist() for c in batch.columns]):
                x, y = _window_hashes(b, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x), pa.array(y), pa.array(np.full(n, doc)), pa.array(pos + np.arange(n))], ["x", "y", "doc", "pos"])
    w = pieces.select("doc", "pos", "n", "bytes").mapInArrow(run, "x long, y long, doc long, pos long")
    first = w.groupBy("x", "y").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("m")).where("m > 1")
    return (w.join(first, ["x", "y"]).where(F.struct("doc", "pos") != F.col("first"))
            .select("doc", "pos", F.lit(1).cast("long").alias("n")))


def _cut(docs: DataFrame) -> DataFrame:
    """docs (doc_id, body, whole, spans) -> the counts and what is kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for body, whole, spans in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                body = body or b""
                if whole and len(body) >= SPAN:
                    rows.append((len(body), len(body), 1, b""))
                elif not spans:
                    rows.append((len(body), 0, 0, body))
                else:
                    s = np.array([(x["lo"], x["n"]) for x in spans])
                    mark = np.zeros(len(body) + 1, np.int64)
                    np.add.at(mark, s[:, 0], 1)
                    np.add.at(mark, s[:, 0] + s[:, 1] + SPAN - 1, -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    rows.append((len(body), int(gone.sum()), runs, np.frombuffer(body, np.uint8)[~gone].tobytes()))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "body", "whole", "spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                   shard_bytes: int = SHARD_BYTES, hot_runs: int = HOT_RUNS,
                   bitmap_words: int = BITMAP_WORDS) -> DataFrame:
    """Remove every byte covered by a 100-byte string that also starts
    earlier (smaller id, or same document, earlier start), judged on the
    input: doc_id, n_bytes, n_removed, n_spans, kept (binary); one row per
    input row.

    Ids are integers.  Defined cases: a null text has no bytes; null ids
    come last; rows equal in id and text are one document and get equal
    results; rows that share an id only are ordered by a hash of their text;
    a text may be of any length; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = _keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body")))
    several = docs.where(F.length("body") >= SPAN).groupBy("t1", "t2").agg(F.min("doc").alias("rep"), F.max("doc").alias("top"))
    several = materialise(several.where("top > rep").select("t1", "t2", "rep"), "sd-copies")
    marked = docs.join(broadcast_if_small(several, BROADCAST), ["t1", "t2"], "left").withColumn("whole", F.coalesce(F.col("doc") > F.col("rep"), F.lit(False)))
    first = marked.where(~F.col("whole") & (F.length("body") >= SPAN))

    # the bitmap lets few others pass while it is mostly empty; beyond that
    # all bits are set and a join picks the runs
    repeated = materialise(_counts(first).where("n > 1").select("h"), "sd-repeated")
    few = repeated.count() <= bitmap_words * 8
    bits = _bitmap(repeated, bitmap_words) if few else np.full(bitmap_words, ~np.uint64(0))
    bitmap = spark.sparkContext.broadcast(bits)
    runs = _runs(first, bitmap)
    runs = materialise(runs if few else runs.join(repeated, "h", "left_semi"), "sd-runs")
    classes = runs.groupBy("h", "c").agg(F.min(F.struct("doc", "pos")).alias("first"), F.first("n").alias("n"), F.count("*").alias("m"))
    classes = materialise(classes, "sd-classes")
    again = broadcast_if_small(materialise(classes.where("m > 1").select("h", "c", "first"), "sd-again"), BROADCAST)
    same = runs.join(again, ["h", "c"]).where(F.struct("doc", "pos") != F.col("first")).select("doc", "pos", "n")

    mixed = materialise(classes.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "sd-mixed")
    left = classes.join(broadcast_if_small(mixed, BROADCAST), "h").select(
        "h", "k", "first.doc", F.shiftright("first.pos", 32).alias("th"), F.col("first.pos").bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"), "n")
    left = materialise(left, "sd-left")
    total = left.where(F.col("k") <= hot_runs).agg(F.sum(F.col("n") + SPAN)).first()[0] or 0
    shards = int(total // shard_bytes) + 1
    wanted = materialise(left.groupBy("doc", "th").agg(F.collect_list(F.struct("h", "k", "lo", "n")).alias("runs")), "sd-wanted")
    pieces = materialise(_bytes_of(first, wanted), "sd-pieces")
    sorted_ = (pieces.where(F.col("k") <= hot_runs).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
               .groupBy("shard").applyInPandas(_shard, "doc long, pos long, n long"))
    gone = same.unionByName(sorted_).unionByName(_split_hot(pieces.where(F.col("k") > hot_runs)))
    gone = (gone.groupBy("doc", F.shiftright("pos", 32).alias("th"))
            .agg(F.collect_list(F.struct(F.col("pos").bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"), "n")).alias("spans")))
    gone = materialise(gone, "sd-gone")
    bitmap.destroy()
    drop(repeated, runs, classes, mixed, left, wanted, pieces)
    no_spans = F.lit(None).cast(gone.schema["spans"].dataType).alias("spans")
    whole = _among(marked, gone, "left_anti").select("doc_id", "body", "whole", no_spans)
    cut = _among(marked, gone, "left_semi").join(gone, ["doc", "th"]).select("doc_id", "body", "whole", "spans")
    return _cut(whole.unionByName(cut))
