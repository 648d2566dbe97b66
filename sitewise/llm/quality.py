"""Quality rules with cross-document line frequency.

A first pass over the texts gives the distinct normalised lines of each
document as hashes.  Distinct documents per (host, line) are counted by two
aggregates that combine on the map side; lines above the limit are boilerplate
of that host.  A second pass takes them out of the documents that have any,
gives the counts of the base rules, and rejects a document of which too little
is left.  Only documents with boilerplate are joined with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import broadcast_if_small, drop, materialise, slices
from .shingles import WordHashes, grams

# fixed value: the characters that count as symbols
SYMBOLS = b"#*$%&|<>"
_DIGITS = re.compile(rb"[0-9]+")
_WHITE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
PLATE_ROWS = 100_000  # documents with boilerplate that may be broadcast with its hashes
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_left"]


def repeated_words(h: np.ndarray, k: int) -> int:
    """Words inside ``k``-word windows that occur twice or more."""
    g = grams(h, k)
    if len(g) < 2:
        return 0
    _, inverse, counts = np.unique(g, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(h) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def normalised(line: bytes) -> bytes:
    """ASCII lower case, white space runs as one blank, digit runs as 0."""
    return _DIGITS.sub(b"0", b" ".join(line.lower().split()))


def line_hash(line: bytes) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(normalised(line)))))


def lines_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, host, th, body) -> doc_id, host, th and lines: the hashes
    of the distinct normalised lines that have a word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lines = [list({line_hash(x) for x in (body or b"").split(b"\n") if x.strip(_WHITE)}) for body in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lines, pa.list_(pa.int64()))], ["doc_id", "host", "th", "lines"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "host", "th", "body").mapInArrow(run, f"doc_id {kind}, host string, th long, lines array<long>")


def without_lines(body: bytes, plates: set[int]) -> bytes:
    """A text without the lines whose normalised form is among ``plates``."""
    return b"\n".join(x for x in body.split(b"\n") if not x.strip(_WHITE) or line_hash(x) not in plates)


def judged(docs: DataFrame, k: int, with_text: bool) -> DataFrame:
    """docs (doc_id, body, plates) -> doc_id, the base counts, n_left (words
    outside boilerplate lines) and, if wanted, the text that is left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in slices(batches):
            rows, left = [], []
            for body, plates in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = None if body is None else without_lines(body, set(plates)) if plates else body
                body = body or b""
                w = body.split()
                chars = len(body.translate(None, _WHITE + _CONTINUATION))
                symbols = len(body) - len(body.translate(None, SYMBOLS))
                seen, dup = set(), 0
                for line in body.split(b"\n"):
                    if line.strip(_WHITE):
                        dup += line in seen
                        seen.add(line)
                rows.append((len(w), chars, symbols, dup, repeated_words(memory.of(w), k), len(text.split()) if plates else len(w)))
                left.append(text)
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(COUNTS)
            # checked as UTF-8, as lines are cut at an ASCII byte
            more = [pa.array(left, pa.binary()).cast(pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, *more], ["doc_id", *COUNTS, *["text"] * with_text])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", text string" * with_text
    return docs.select("doc_id", "body", "plates").mapInArrow(run, schema)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *,
            min_words: int = 20, max_repeat_percent: int = 30, min_docs: int = 20,
            max_share: float = 0.02, min_left: float = 0.5, with_text: bool = True) -> DataFrame:
    """Quality verdict of whole texts: doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, n_boilerplate
    (words in boilerplate lines), kept and, unless ``with_text`` is off, text:
    the text without its boilerplate lines; one row per input row.

    A normalised line is boilerplate of a host if more than ``min_docs`` and
    more than ``max_share`` of the host's distinct documents have it.  A
    document is rejected if the base rules fail (fewer than ``min_words``
    words, or more than ``max_repeat_percent`` % of them in repeated 8-word
    windows), or if the words outside boilerplate are fewer than
    ``min_words`` or less than ``min_left`` of all.  Defined cases: a null
    text has no words and stays null; null hosts are a host of their own; rows with one id
    count as one document in the line counts, rows with a null id as one; an
    empty table gives an empty result; other columns are ignored, whatever
    their names.
    """
    body = docs.select(F.col(id_col).alias("doc_id"), F.to_json(F.struct(F.col(host_col).cast("string").alias("host"))).alias("host"),
                       F.col(text_col).cast("binary").alias("body")).withColumn("th", F.xxhash64("body"))
    c = materialise(lines_of(body), "ql-lines")
    hosts = c.select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    flat = c.select("doc_id", "host", "th", F.explode("lines").alias("line"))
    # (host, line) of one document only cannot be above the limit, so a first
    # aggregate over (host, line) drops most groups before ids are counted
    often = flat.groupBy("host", "line").agg(F.count("*").alias("rows")).where(F.col("rows") > min_docs)
    often = materialise(often.select("host", "line"), "ql-often")
    near = flat.join(broadcast_if_small(often), ["host", "line"])
    per_line = (near.select("host", "line", "doc_id").distinct().groupBy("host", "line").agg(F.count("*").alias("in_docs")))
    plate = (per_line.join(hosts, "host").where((F.col("in_docs") > min_docs) & (F.col("in_docs") > max_share * F.col("docs")))
             .select("host", "line"))
    plate = materialise(plate, "ql-plate")
    plates = flat.join(broadcast_if_small(plate), ["host", "line"]).groupBy("doc_id", "host", "th").agg(F.collect_set("line").alias("plates"))
    plates = materialise(plates.select(F.col("doc_id").alias("pid"), F.col("host").alias("ph"), F.col("th").alias("pt"), "plates"), "ql-plates")
    drop(c, often, plate)
    with_plates = body.join(broadcast_if_small(plates, PLATE_ROWS), (F.col("th") == F.col("pt")) & (F.col("host") == F.col("ph"))
                            & F.col("doc_id").eqNullSafe(F.col("pid")), "left")
    out = judged(with_plates, 8, with_text)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_left")
    kept = ~failed & (left >= min_words) & (left >= min_left * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                      (F.col("n_words") - left).alias("n_boilerplate"), kept.alias("kept"), *["text"] * with_text)
