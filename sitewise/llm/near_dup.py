"""MinHash near-duplicates with odd sketches.

Every distinct text gets ``rows * bands`` MinHash samples.  Bands of ``rows``
samples propose pairs; the samples folded into a parity bitmap (odd sketch)
prune them, as the population count of the XOR of two bitmaps estimates how
many samples differ; full shingle sets confirm what is left, so a link is
exact.  A pair at the threshold shares no band with probability
(1 - t**rows)**bands, 2e-7 with the defaults.

No pair table of a group is ever made.  Equal texts become one class first.
Each band bucket proposes only (member, smallest member); after those links
are contracted, a bucket whose members are still in several components is
tested pair by pair inside tasks, in tiles of bounded size, which return at
most one link per merge.  So every pair that shares a band is either tested
or already connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import broadcast_if_small, drop, is_empty, materialise, slices
from .shingles import WordHashes, mix, shingle_set

SKETCH_BITS = 512
TILE = 512


def _as_long(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def minhash_samples(s: np.ndarray, mult: np.ndarray, xor: np.ndarray) -> np.ndarray:
    """Minimum of every hash function over a non-empty shingle set, in blocks
    so that a very long text takes no more memory."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(mult), np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 1024):
        best = np.minimum(best, ((x[i:i + 1024, None] ^ xor) * mult).min(0))
    return best


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmap of (position, sample) pairs as uint64 words."""
    h = mix(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32)))
    parity = np.bincount((h >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.uint64)


def sketch_limit(samples: int, threshold: float, bits: int = SKETCH_BITS, sigmas: float = 5.0) -> int:
    """Largest XOR count kept: the expected count of a pair at the threshold
    and ``sigmas`` standard deviations of sampling and of folding."""
    differ = 2 * samples * (1 - threshold)
    rate = math.exp(-2 * differ / bits)
    sampling = 2 * math.sqrt(samples * threshold * (1 - threshold)) * rate
    folding = math.sqrt(bits * (1 - rate * rate) / 4)
    return math.ceil(bits / 2 * (1 - rate) + sigmas * math.hypot(sampling, folding))


def _hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return (rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1),
            rng.integers(0, 2**32, n, dtype=np.uint32))


def signatures(docs: DataFrame, rows: int = 4, bands: int = 40, k: int = 5) -> DataFrame:
    """docs (doc_id, body binary) -> doc_id, n_shingles, text_key (of the
    word sequence; null without words), bands, sketch."""
    mult, xor = _hash_functions(rows * bands)
    salts = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in slices(batches):
            n, keys, band, sketch = [], [], [], []
            for body in batch.column(1).to_pylist():
                words = (body or b"").lower().split()
                s = shingle_set(memory.of(words), k)
                n.append(len(s))
                if not len(s):
                    keys.append(None), band.append([]), sketch.append([])
                    continue
                m = minhash_samples(s, mult, xor)
                h = m.reshape(bands, rows).astype(np.uint64)
                key = salts.copy()
                for j in range(rows):
                    key = mix(key + h[:, j])
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                band.append(_as_long(key))
                sketch.append(_as_long(odd_sketch(m)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(band, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "text_key", "bands", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "body").mapInArrow(
        run, f"doc_id {kind}, n_shingles long, text_key binary, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """docs (id, body binary) -> id, shingles array<long>."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in slices(batches):
            sets = [_as_long(shingle_set(memory.of((b or b"").lower().split()), k))
                    for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))],
                                             ["id", "shingles"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "body").mapInArrow(run, f"id {kind}, shingles array<long>")


def _similar(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def _tile_links(percent: int, limit: int):
    """Function for one tile: links between different components."""
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("id")
        ids, comp, block = tile["id"].tolist(), tile["component"].tolist(), tile["block"].to_numpy()
        sk = np.array(tile["sketch"].tolist(), dtype=np.int64).view(np.uint64)
        sets: dict[int, frozenset] = {}
        raw = tile["shingles"].tolist()
        parent: dict = {}

        def find(x):
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        def the_set(i):
            if i not in sets:
                sets[i] = frozenset(raw[i].tolist())
            return sets[i]

        out = []
        crossing = tile["i"].iloc[0] != tile["j"].iloc[0]
        for i in range(len(ids)):
            far = np.bitwise_count(sk[i + 1:] ^ sk[i]).sum(1, dtype=np.int64)
            ok = far <= limit
            if crossing:
                ok &= block[i + 1:] != block[i]
            for j in (np.flatnonzero(ok) + i + 1).tolist():
                a, b = find(comp[i]), find(comp[j])
                if a == b:
                    continue
                x, y = the_set(i), the_set(j)
                if _similar(len(x & y), len(x), len(y), percent):
                    parent[max(a, b)] = min(a, b)
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["src", "dst"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                    percent: int = 75, rows: int = 4, bands: int = 40, k: int = 5,
                    tile: int = TILE) -> DataFrame:
    """Near-duplicate groups of whole texts: doc_id, n_shingles,
    component_id, kept; one row per input row.

    A text's set: its distinct ``k``-word shingles (ASCII lower case, words
    between ASCII white space); a shorter text is one shingle.  Rows are
    linked where 100 * intersection >= percent * union.  component_id is the
    smallest id reachable.  Defined cases: a null text or one without words
    has n_shingles 0 and links with nothing; rows that share an id are one
    vertex and get the same verdict; a row with a null id takes no part,
    has a null component_id and is kept; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    body = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    sig = materialise(signatures(body, rows, bands, k), "nd-signatures")
    limit = sketch_limit(rows * bands, percent / 100)

    # one class per distinct word sequence, named by its smallest id
    named = sig.where("doc_id is not null and text_key is not null")
    rep = materialise(named.groupBy("text_key").agg(
        F.min("doc_id").alias("id"), F.min_by(F.struct("bands", "sketch"), "doc_id").alias("s"),
        F.min("n_shingles").alias("n")).select("text_key", "id", "n", "s.bands", "s.sketch"), "nd-classes")
    copies = (named.select("doc_id", "text_key").join(rep.select("text_key", "id"), "text_key")
              .where("doc_id <> id").select(F.col("doc_id").alias("src"), F.col("id").alias("dst")))

    # buckets with several members, each with its smallest as centre
    member = rep.select("id", F.explode("bands").alias("bucket"))
    several = materialise(member.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("m"))
                          .where("m > 1"), "nd-buckets")
    member = materialise(member.join(broadcast_if_small(several), "bucket"), "nd-members")
    if is_empty(member):
        edges, labels = copies, components(copies)
        return _verdict(sig, labels)

    # shingle sets of the proposed documents only
    wanted = materialise(member.select("id").distinct(), "nd-wanted")
    sketches = rep.select("id", "n", "sketch").join(broadcast_if_small(wanted), "id")
    texts = body.withColumnRenamed("doc_id", "id").join(broadcast_if_small(wanted), "id")
    # an id may have several rows: the class is known by the row's own key
    sets = materialise(shingle_sets(texts, k).dropDuplicates(["id", "shingles"])
                       .join(sketches, "id").where(F.size("shingles") == F.col("n")), "nd-sets")

    star = member.where("id <> centre").select("id", "centre").distinct()
    slim = sets.select("id", "sketch")
    far = sum((F.bit_count(F.col("p")[w].bitwiseXOR(F.col("q")[w])) for w in range(SKETCH_BITS // 64)),
              F.lit(0))
    star = (star.join(slim.withColumnRenamed("sketch", "p"), "id")
            .join(slim.select(F.col("id").alias("centre"), F.col("sketch").alias("q")), "centre")
            .where(far <= limit).select("id", "centre"))
    full = sets.select("id", F.col("shingles").alias("x"))
    common = F.size(F.array_intersect("x", "y"))
    star = (star.join(full, "id")
            .join(full.select(F.col("id").alias("centre"), F.col("x").alias("y")), "centre")
            .where(_similar(common, F.size("x"), F.size("y"), percent))
            .select(F.col("id").alias("src"), F.col("centre").alias("dst")))
    star = materialise(star.unionByName(copies), "nd-star")
    labels = components(star)

    # buckets whose members are still in several components
    left = member.where("m > 2").select("bucket", "id").join(labels, "id", "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("component"))
    mixed = (left.groupBy("bucket").agg(
        F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.bit_xor(F.xxhash64("id")).alias("sign"), F.sum(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 40))).alias("sum"))
        .where("m > 2 and lo <> hi").groupBy("m", "sign", "sum").agg(F.min("bucket").alias("bucket")))
    mixed = materialise(mixed.select("bucket", F.ceil(F.col("m") / tile).alias("g")), "nd-mixed")
    block = F.pmod(F.xxhash64("id", F.lit(2)), F.col("g"))
    tiles = (left.join(broadcast_if_small(mixed), "bucket").withColumn("block", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
             .select("bucket", "id", "component", "block", F.least("block", "other").alias("i"),
                     F.greatest("block", "other").alias("j")))
    tiles = tiles.join(sets.select("id", "sketch", "shingles"), "id")
    kind = sets.schema["id"].dataType.simpleString()
    more = materialise(tiles.groupBy("bucket", "i", "j").applyInPandas(
        _tile_links(percent, limit), f"src {kind}, dst {kind}"), "nd-more")
    old = labels
    if not is_empty(more):
        labels = components(star.unionByName(more))
        drop(old)
    drop(rep, several, member, wanted, sets, star, mixed, more)
    return _verdict(sig, labels)


def _verdict(sig: DataFrame, labels: DataFrame) -> DataFrame:
    return (sig.select("doc_id", "n_shingles").join(labels, sig["doc_id"] == labels["id"], "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
