"""Language identification by a byte convolutional network.

Network: byte embedding, filters of several widths, ReLU, maximum over the
positions of a fixed-length window, softmax over languages.  It is trained
with numpy on a bounded sample of labelled windows.  For prediction the
embedding is multiplied into the filters once, which leaves one table of
(byte value, filter) per filter position; the convolution of a block of
windows is a sum of table look-ups.  Every text is cut into windows from its
first to its last byte, and its class probabilities are the mean over its
windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import broadcast_if_small, materialise, slices

LENGTH = 256  # bytes in a window
WIDTHS = (2, 3, 4, 5)
FILTERS = 8  # of each width
EMBED = 8


class ByteCnn:
    """Parameters and numpy code of the network."""

    def __init__(self, labels: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"E": rng.normal(0, 0.5, (256, EMBED)), "c": np.zeros(len(labels)),
                  "V": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(labels)))}
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.fuse()

    def fuse(self) -> None:
        """Per width, tables[j][byte] = embedding of the byte times row j of
        the filters."""
        self.tables = {w: np.einsum("vd,jdf->jvf", self.p["E"], self.p[f"W{w}"]) for w in WIDTHS}

    def convolve(self, x: np.ndarray, w: int) -> np.ndarray:
        n = x.shape[1] - w + 1
        t = self.tables[w]
        out = t[0][x[:, :n]]
        for j in range(1, w):
            out += t[j][x[:, j:j + n]]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(windows, LENGTH) bytes -> (windows, labels)."""
        h = np.concatenate([self.convolve(x, w).max(1) + self.p[f"b{w}"] for w in WIDTHS], 1)
        z = np.maximum(h, 0) @ self.p["V"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        self.fuse()
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        top, at = [], {}
        for w in WIDTHS:
            c = self.convolve(x, w)
            at[w] = c.argmax(1)  # (windows, filters)
            top.append(np.take_along_axis(c, at[w][:, None], 1)[:, 0] + self.p[f"b{w}"])
        h = np.concatenate(top, 1)
        r = np.maximum(h, 0)
        z = r @ self.p["V"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g["V"], g["c"] = r.T @ d, d.sum(0)
        dh = (d @ self.p["V"].T) * (h > 0)
        rows = np.arange(len(x))[:, None]
        for i, w in enumerate(WIDTHS):
            dw = dh[:, i * FILTERS:(i + 1) * FILTERS]
            g[f"b{w}"] = dw.sum(0)
            for j in range(w):
                seen = x[rows, at[w] + j]  # (windows, filters) byte values
                e = self.p["E"][seen]  # (windows, filters, embed)
                g[f"W{w}"][j] = np.einsum("nfd,nf->df", e, dw)
                np.add.at(g["E"], seen, dw[:, :, None] * self.p[f"W{w}"][j].T[None])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int = 5, rate: float = 0.01, batch: int = 64) -> None:
        """Adam on the cross-entropy."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                pick = order[i:i + batch]
                step += 1
                for k, g in self.gradients(x[pick], y[pick]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.fuse()


def windows_of(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text (the last one padded) and their byte counts."""
    n = -(-len(body) // LENGTH)
    x = np.zeros(n * LENGTH, np.uint8)
    x[:len(body)] = np.frombuffer(body, np.uint8)
    size = np.full(n, LENGTH, np.float64)
    size[-1] = len(body) - (n - 1) * LENGTH
    return x.reshape(n, LENGTH), size


def train(docs: DataFrame, labelled: Column, *, per_label: int = 600, max_sample: int = 20_000,
          epochs: int = 5) -> ByteCnn | None:
    """Network from docs (doc_id, text, lang): of the rows where ``labelled``
    holds, at most ``per_label`` windows of each label and ``max_sample`` in
    all, the first by a hash, each from a hashed place in its text."""
    raw = F.col("text").cast("binary")
    h = F.xxhash64(F.lit(11), "text")
    at = F.pmod(h, F.greatest(F.length(raw) - LENGTH + 1, F.lit(1))).cast("int") + 1
    labelled = labelled & F.col("lang").isNotNull() & (F.length(raw) > 0)
    # hashes are even: a multiple of the rows wanted passes, whatever the size
    often = docs.where(labelled).groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n"))
    often = broadcast_if_small(materialise(often, "lang-counts"))
    sample = docs.where(labelled).select("lang", h.alias("h"), F.substring(raw, at, F.lit(LENGTH)).alias("b"))
    sample = sample.join(often, F.col("lang") == F.col("l")).where(F.col("h") / 2.0**64 + 0.5 < 4.0 * per_label / F.col("n"))
    sample = sample.select("lang", "h", "b").distinct()  # a text with many copies counts once
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "b"))
    sample = sample.withColumn("r", rank).where(F.col("r") <= per_label)
    rows = sample.orderBy("r", "h", "b", "lang").limit(max_sample).select("lang", "b").collect()
    if not rows:
        return None
    labels = sorted({r["lang"] for r in rows})
    x = np.zeros((len(rows), LENGTH), np.uint8)
    for i, r in enumerate(rows):
        x[i, :len(r["b"])] = np.frombuffer(bytes(r["b"]), np.uint8)
    y = np.array([labels.index(r["lang"]) for r in rows])
    net = ByteCnn(labels)
    # small samples go round more often, so that training has as many steps
    net.fit(x, y, max(epochs, -(-1500 * 5 // len(y))))
    return net


def predict(docs: DataFrame, net: ByteCnn | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score."""
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("body"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if net is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            labels, scores = [], []
            for body, letters in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not letters:
                    labels.append("und"), scores.append(0.0)
                    continue
                x, size = windows_of(body)
                p = sum(size[i:i + 64] @ net.probabilities(x[i:i + 64]) for i in range(0, len(x), 64)) / size.sum()
                labels.append(net.labels[int(p.argmax())])
                scores.append(float(min(1.0, p.max())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
             carry: list[str] | None = None, **fit) -> DataFrame:
    """Predicted language of every whole text: doc_id, held_out, lang_pred,
    score and, if ``carry`` names input columns, those as the struct
    ``rest``; one row per input row.

    Learns from text and label of rows whose crc32(id as text) mod 4 is not
    2; those with 2, and null ids, are held out.  Predictions see the text
    only.  Defined cases: a null text or one without a letter is ``und``
    with score 0; without any labelled row everything is ``und``; an empty
    table gives an empty result; rows are independent, so repeated rows get
    equal results; other columns are ignored, whatever their names.
    """
    rest = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest")] if carry else []
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), *rest)
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    net = train(docs, fold != 2, **fit)
    if carry:  # the id goes with what is carried through the network
        out = predict(docs.withColumn("doc_id", F.struct("doc_id", "rest")), net).select("doc_id.*", "lang_pred", "score")
        return out.select("doc_id", F.coalesce(fold == 2, F.lit(True)).alias("held_out"), "lang_pred", "score", "rest")
    out = predict(docs, net)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")
