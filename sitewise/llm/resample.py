"""Importance resampling of documents towards a target distribution of
hashed word n-grams.

Features are all runs of 1 to 3 consecutive words; a feature's bucket is the
CRC-32 of its text modulo the number of buckets.  An Arrow function joins the
texts of a batch with a sentinel between them, finds all words and sentinels
with one regex pass, and numbers them; the CRC-32 of a run follows from those
of its words (``Crc``), so all runs of the batch are array operations.  The
documents' offsets among the words, looked up by searchsorted, mask the runs
that reach over a sentinel, and bincount counts the rest.

The first pass counts the buckets of all documents and of the target, a table
of one row a bucket whatever the input; it gives each bucket its gain.  The
second pass sums the gains of each document.  Every document gets a Gumbel
term from a hash of its id, and the highest scores are a draw without
replacement: ranks come from a range-partitioned sort, the row numbers inside
the partitions and the sums of the partitions before.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise, slices

SENTINEL = b"\0"
# A-Z in lower case; a byte of the sentinel's value separates words like any other
_LOWER = bytes(b" "[0] if b == 0 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+|\x00")
_SEPARATOR = re.compile(rb"[^0-9a-z\x80-\xff]")
CALL_BYTES = 1 << 20


def _times_x(c: np.ndarray) -> np.ndarray:
    """CRC state moved on by one zero byte."""
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (c & np.uint32(1)))
    return c


class Crc:
    """CRC-32 of joined strings: crc(a + b) is crc(a) moved on by the length
    of b, exclusive-or crc(b).  Moving on is linear, so a move by n bytes is
    four look-ups by the bytes of the state; longer moves are put together of
    powers of two."""

    NEAR = 64

    def __init__(self):
        rows = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
        table = np.stack(rows)
        near = [table]
        for _ in range(1, self.NEAR):
            near.append(_times_x(near[-1]))
        self.near = np.stack(near)  # [bytes, place, value]
        self.power = [_times_x(near[-1])]  # a move by NEAR bytes, twice that, ...

    @staticmethod
    def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
        m = np.uint32(255)
        return (table[0][c & m] ^ table[1][(c >> np.uint32(8)) & m] ^ table[2][(c >> np.uint32(16)) & m] ^ table[3][c >> np.uint32(24)])

    def move(self, c: np.ndarray, by: np.ndarray) -> np.ndarray:
        near, m = by % self.NEAR, np.uint32(255)
        t = self.near
        out = (t[near, 0, c & m] ^ t[near, 1, (c >> np.uint32(8)) & m] ^ t[near, 2, (c >> np.uint32(16)) & m] ^ t[near, 3, c >> np.uint32(24)])
        far = np.flatnonzero(by >= self.NEAR)
        left, k = by[far] // self.NEAR, 0
        while left.any():
            if k == len(self.power):
                self.power.append(self._apply(self.power[-1], self.power[-1]))
            odd = far[left % 2 == 1]
            out[odd] = self._apply(self.power[k], out[odd])
            left, k = left // 2, k + 1
        return out


class Words(dict):
    """Numbers of words within one task, 0 for the sentinel, with the CRC-32
    and length of each, alone and behind a blank; emptied between calls when
    there are ``limit`` of them, which only saves time."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit
        self.start()

    def start(self) -> None:
        self.clear()
        self[SENTINEL] = 0
        self.values = np.zeros((3, 1024), np.int64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == self.values.shape[1]:
            self.values = np.concatenate([self.values, np.zeros_like(self.values)], axis=1)
        self.values[:, n] = zlib.crc32(word), zlib.crc32(b" " + word), len(word) + 1
        self[word] = n
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def pieces(text: bytes, size: int, longest: int) -> list[tuple[bytes, int]]:
    """A lower-cased text in pieces of about ``size`` bytes, cut between
    words; a piece starts with the last ``longest - 1`` words of the one
    before it, whose number is given beside it."""
    out, start, carry = [], 0, []
    while len(text) - start > size:
        cut = _SEPARATOR.search(text, start + size)
        if cut is None:
            break
        body = text[start:cut.start()]
        out.append((b" ".join([*carry, body]), len(carry)))
        last = [w for w in _WORD.findall(text, max(start, cut.start() - (1 << 12)), cut.start())]
        if len(last) <= longest:  # a word may be cut at the front, or few be there
            last = carry + _WORD.findall(body)
        carry = last[len(last) - (longest - 1):] if len(last) >= longest - 1 else last
        start = cut.start()
    out.append((b" ".join([*carry, text[start:]]), len(carry)))
    return out


class Features:
    """Buckets of the word runs of many texts at a time."""

    def __init__(self, buckets: int, longest: int = 3, call_bytes: int = CALL_BYTES):
        self.buckets, self.longest, self.call_bytes = buckets, longest, call_bytes
        self.words, self.crc = Words(), Crc()

    def calls(self, texts: list[bytes | None]):
        """(owners, texts, carried words) of batches of about ``call_bytes``."""
        owner, parts, carried, held = [], [], [], 0
        for i, text in enumerate(texts):
            for part, carry in pieces((text or b"").translate(_LOWER), self.call_bytes, self.longest):
                owner.append(i)
                parts.append(part)
                carried.append(carry)
                held += len(part)
                if held >= self.call_bytes:
                    yield owner, parts, carried
                    owner, parts, carried, held = [], [], [], 0
        if parts:
            yield owner, parts, carried

    def runs(self, parts: list[bytes], carried: list[int]):
        """For each length of run: the part and the bucket of every run; of a
        part's carried words alone, none."""
        if len(self.words) > self.words.limit:
            self.words.start()
        ids = self.words.of(_WORD.findall(SENTINEL.join(parts)))
        single, behind, length = self.words.values[:, ids]
        single, behind = single.astype(np.uint32), behind.astype(np.uint32)
        offsets = np.flatnonzero(ids == 0)  # of the sentinels
        place = np.arange(len(ids))
        part = np.searchsorted(offsets, place)
        # the first word of each part that is not carried
        fresh = np.concatenate([[0], offsets + 1])[part] + np.array(carried, np.int64)[part]
        is_word = ids != 0
        crc = single
        for k in range(1, self.longest + 1):
            if k > 1:
                n = max(len(ids) - k + 1, 0)
                crc = self.crc.move(crc[:n], length[k - 1:]) ^ behind[k - 1:]
            n = len(crc)
            last = place[k - 1:]
            # sentinels belong to the part before them, so a run inside one
            # part is free of them unless it ends with one
            inside = (part[:n] == part[k - 1:]) & is_word[k - 1:] & (last >= fresh[k - 1:])
            yield part[:n][inside], (crc[inside] % np.uint32(self.buckets)).astype(np.int64), k

    def count(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.zeros(self.buckets, np.int64)
        for _, parts, carried in self.calls(texts):
            for _, bucket, _ in self.runs(parts, carried):
                out += np.bincount(bucket, minlength=self.buckets)
        return out

    def weigh(self, texts: list[bytes | None], gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, features and summed gain of each text."""
        n_words, n_features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
        for owner, parts, carried in self.calls(texts):
            owner = np.array(owner, np.int64)
            for part, bucket, k in self.runs(parts, carried):
                who = owner[part]
                np.add.at(n_features, owner, np.bincount(part, minlength=len(owner)))
                if k == 1:
                    np.add.at(n_words, owner, np.bincount(part, minlength=len(owner)))
                np.add.at(weight, who, gain[bucket])
        return n_words, n_features, weight


def bucket_counts(texts: DataFrame, text_col: str = "text", *, buckets: int = 10_000, longest: int = 3) -> DataFrame:
    """(bucket, n): features of all texts by bucket; one row a task and
    bucket goes into the shuffle."""
    def count(batches):
        features, total = Features(buckets, longest), np.zeros(buckets, np.int64)
        for batch in slices(batches):
            total += features.count(batch.column(0).to_pylist())
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("binary").alias("body")).mapInArrow(count, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of every bucket from the counts of both sides, which are one row a
    bucket: floor(1000 ln of the ratio of the smoothed shares), in doubles."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, into in ((source, s), (target, t)):
        for r in counts.collect():
            into[r.bucket] = r.n
    ratio = ((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(id_col: str, seed: int) -> F.Column:
    """Thousandths of a Gumbel variate from the hash of ``seed:id``, floored."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(df: DataFrame, *order: F.Column) -> DataFrame:
    """``df`` with ``rank`` from 1 on: a sort over range partitions, written
    with partition and row number in one long, and the rows of the partitions
    before added.  Only the partitions' numbers of rows, one row each, meet in
    one place."""
    placed = materialise(df.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "rs-sorted")
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    out = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return out.withColumn("rank", F.col("before") + row + 1).drop("part", "place", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
             target_text: str = "text", percent: int = 5, min_words: int = 20, buckets: int = 10_000,
             longest: int = 3, seed: int = 42) -> DataFrame:
    """Draw ``percent`` % of the documents of ``min_words`` words or more, by
    importance for the texts of ``target``: doc_id, n_words, n_features,
    weight, score, rank (1 for the first drawn, null if not drawn); one row
    per input row.

    Words are runs of 0-9, a-z (A-Z in lower case) and non-ASCII characters.
    weight is the sum of the gains of the document's features, score adds the
    Gumbel term of its id.  Equal scores go by id, null ids last, then by
    number of features.  Defined cases: a null or empty text has no words, no
    features and weight 0; rows that share an id share the Gumbel term and
    are ranked one by one; a null id is hashed as an empty one; an empty
    target gives gains from the documents alone; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    body = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    gain = gains(bucket_counts(docs, text_col, buckets=buckets, longest=longest),
                 bucket_counts(target, target_text, buckets=buckets, longest=longest), buckets)

    def weigh(batches):
        features = Features(buckets, longest)
        for batch in slices(batches):
            n_words, n_features, weight = features.weigh(batch.column(1).to_pylist(), gain)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]],
                                             ["doc_id", "n_words", "n_features", "weight"])

    scored = body.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    scored = materialise(scored.withColumn("score", F.col("weight") + gumbel("doc_id", seed)), "rs-scores")
    fit = scored.where(F.col("n_words") >= min_words)
    drawn = fit.count() * percent // 100
    order = ranked(fit, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"))
    order = order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    cols = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return order.select(cols).unionByName(rest.select(cols))
