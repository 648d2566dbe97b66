"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens.  In round t queue i may have sent
``floor(t * quantum_i)`` tokens in all, quantum_i being its target share of a
round; what the floor withholds is the deficit it carries on, over windows
and partitions alike.  A queue whose quantum is below ``grain`` tokens saves
its deficit until it can send a whole grain, each queue at rounds of its own,
so a text is not cut finer the more sources there are.  An empty queue drops
out and the others go on in their proportions.  The stream of all rounds is
cut every ``window`` tokens, so every window but the last is full and holds
the target proportions to within a quantum or a grain of each queue.

Queues beyond a number of the largest are dealt to groups by a hash.  A group
is a queue of the round-robin above whose own stream is a second round-robin
over its members, so every source keeps its proportion, however many there
are.

Because the tokens sent by round t have a closed form, a document's place
follows from its offset in its queue alone, first in its group, then in the
stream.  Offsets are a prefix sum: each partition counts as it tokenises, and
the (source, partition) totals, a table of a few numbers a partition, are
summed up by a window.  No text or token is shuffled while these tables are
small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import BROADCAST_ROWS, broadcast_if_small, materialise, slices
from .tokens import chunk_ids, default_path

SCALE = 1 << 30  # quantum shares are integers of this sum, about
PHASE = 40503  # odd: spreads the rounds in which small queues send
GRAIN = 64  # tokens a queue saves up at least


class Rounds:
    """Tokens sent by all queues up to a round.  Rounds are 64-bit numbers:
    at the least share, 1 of ``SCALE``, and 4096 tokens a round a queue may
    hold 3e13 tokens; beyond that numpy raises an OverflowError."""

    def __init__(self, totals: list[int] | np.ndarray, shares: list[float] | np.ndarray, round_tokens: int, grain: int = 1):
        self.totals = np.asarray(totals, np.int64)
        shares = np.asarray(shares, float)
        self.w = np.maximum(1, np.rint(SCALE * (shares / shares.sum()))).astype(np.int64)
        self.sum = int(self.w.sum())
        self.round = round_tokens
        # quantum = whole + part / sum
        self.whole, self.part = np.divmod(self.w * round_tokens, self.sum)
        # small quanta are saved up to a grain, each queue from another start
        self.grain = np.where(self.whole < grain, grain, 1)
        self.phase = np.arange(len(self.w)) * PHASE % self.grain
        # rounds after which a queue is empty for sure; no product below goes beyond its total
        per = self.w.astype(object) * round_tokens
        done = -(-(self.totals.astype(object) + self.grain) * self.sum // per)
        self.done = np.minimum(done, (1 << 63) - 1).astype(np.int64)

    def sent(self, t: np.ndarray) -> np.ndarray:
        """(rounds, queues): tokens each queue has sent by the end of round t."""
        t = np.minimum(np.asarray(t, np.int64)[:, None], self.done)
        high, low = np.divmod(t, self.sum)
        due = t * self.whole + high * self.part + low * self.part // self.sum
        return np.minimum(self.totals, (due + self.phase) // self.grain * self.grain)

    def rounds_of(self, queue: int, x: int, n: int) -> np.ndarray:
        """Rounds (from 1) in which tokens x .. x + n of the queue are sent."""
        per, g, phase = int(self.w[queue]) * self.round, int(self.grain[queue]), int(self.phase[queue])

        def at(k: int) -> int:  # the round by which k whole grains are sent
            return -(-(k * g - phase) * self.sum // per)

        first, last = x // g + 1, (x + n - 1) // g + 1
        if self.whole[queue] >= g:  # sends in every round
            return np.arange(at(first), at(last) + 1)
        return np.unique(np.array([at(k) for k in range(first, last + 1)], np.int64))

    def runs(self, queue: int, x: int, n: int, block: int = 512) -> Iterator[tuple[int, int, int]]:
        """(first token, tokens, place in the stream) for tokens x .. x + n;
        tokens that follow each other in the stream are one run."""
        rounds = self.rounds_of(queue, x, n)
        run = None
        for i in range(0, len(rounds), block):
            t = rounds[i:i + block]
            now, before = self.sent(t), self.sent(t - 1)
            lo = np.maximum(before[:, queue], x)
            hi = np.minimum(now[:, queue], x + n)
            place = before.sum(1) + (now - before)[:, :queue].sum(1) + lo - before[:, queue]
            for a, b, p in zip(lo.tolist(), hi.tolist(), place.tolist()):
                if b <= a:
                    continue
                if run and run[0] + run[1] == a - x and run[2] + run[1] == p:
                    run = run[0], run[1] + b - a, run[2]
                    continue
                if run:
                    yield run
                run = a - x, b - a, p
        if run:
            yield run


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, source, body binary) -> doc_id, source, part (partition),
    before (tokens of the source earlier in the partition), n, ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = chunk_ids(path)
        part = TaskContext.get().partitionId()
        sums: dict = {}
        for batch in slices(batches):
            n, before = [], []
            ids = memory.documents(batch.column(2).to_pylist())
            for source, b in zip(batch.column(1).to_pylist(), ids):
                n.append(len(b) // memory.dtype.itemsize)
                before.append(sums.get(source, 0))
                sums[source] = before[-1] + n[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([part] * len(n), pa.int64()),
                 pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "source", "part", "before", "n", "ids"])
        memory.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "source", "body").mapInArrow(
        run, f"doc_id {kind}, source string, part long, before long, n long, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
         window: int = 4096, targets: dict[str, float] | None = None, round_tokens: int | None = None,
         max_queues: int = 1024, grain: int = GRAIN, tokenizer: str | None = None) -> DataFrame:
    """Pack all documents into sequences of ``window`` tokens; one row per
    piece: doc_id, source, start, length, doc_tokens, sequence_id, offset,
    ids (little-endian unsigned 32-bit, binary).

    ``targets`` gives token proportions per source; sources without one
    share what is left up to 1 by size (a hundredth if nothing is left).
    Without targets the proportions are those of the corpus.  Every source
    with a target and the ``max_queues`` / 2 largest others have a queue of
    the first round-robin each; all others are dealt to as many groups, a
    queue each, and have queues of a second round-robin inside their group.
    Defined cases: a null or empty text is one closing id; null sources are
    a queue of their own; a target of a source that does not occur is left
    out; every input row is packed, repeated or with a null id; an empty
    table gives no pieces; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    path = tokenizer or default_path()
    body = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.col(text_col).cast("binary").alias("body"))
    toks = materialise(tokenised(body, path), "pk-tokens")
    sums = materialise(toks.groupBy("source", "part").agg(F.sum("n").alias("n")), "pk-sums")
    per_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    total = per_source.agg(F.sum("n")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], f"doc_id {body.schema['doc_id'].dataType.simpleString()}, source string, "
                                     "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")

    # queues of their own, and the groups of the others
    targets = targets or {}
    named = F.coalesce(F.col("source").isin(list(targets)), F.lit(False))
    groups = max_queues - max_queues // 2
    own = [tuple(r) for r in per_source.where(named).orderBy(F.desc("n"), "source").collect()]
    own += [tuple(r) for r in per_source.where(~named).orderBy(F.desc("n"), "source").limit(max_queues - groups).collect()]
    queue = F.broadcast(spark.createDataFrame([(s, i) for i, (s, _) in enumerate(own)], "qs string, queue long"))
    tail = (per_source.join(queue, per_source["source"].eqNullSafe(F.col("qs")), "left").where("queue is null")
            .select(F.col("source").alias("ms"), "n", F.pmod(F.xxhash64("source"), F.lit(groups)).alias("group")))
    rank = F.row_number().over(Window.partitionBy("group").orderBy("ms")) - 1
    tail = materialise(tail.withColumn("member", rank), "pk-tail")
    shared = materialise(tail.groupBy("group").agg(
        F.sum("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("member", "n"))), lambda m: m["n"]).alias("totals")), "pk-groups")
    of_group = [tuple(r) for r in shared.orderBy("group").select("group", "n").collect()]

    totals = [n for _, n in own] + [n for _, n in of_group]
    given = [targets.get(s) for s, _ in own] + [None] * len(of_group)
    left = max(1 - sum(g or 0 for g in given), 0.01 if targets else 0.0)
    free = sum(n for n, g in zip(totals, given) if g is None) or 1
    shares = [left * n / free if g is None else g for n, g in zip(totals, given)]
    rounds = Rounds(totals, [max(s, 1e-9) for s in shares], round_tokens or window, grain)

    # first token of every (source, partition) in its queue
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", F.col("part").alias("bp"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    base = base.join(queue, F.col("source").eqNullSafe(F.col("qs")), "left")
    base = base.join(broadcast_if_small(tail.drop("n")), F.col("source").eqNullSafe(F.col("ms")), "left")
    at = spark.createDataFrame([(g, len(own) + i) for i, (g, _) in enumerate(of_group)], "og long, oq long")
    base = base.join(F.broadcast(at), F.col("group") == F.col("og"), "left").select(
        F.col("source").alias("bs"), "bp", "base", F.coalesce("queue", "oq").alias("queue"), "group", "member")
    base = broadcast_if_small(materialise(base, "pk-base"))
    placed = toks.join(base, (toks["part"] == F.col("bp")) & toks["source"].eqNullSafe(F.col("bs")))
    if of_group:
        inside = shared.select(F.col("group").alias("ig"), "totals")
        few = tail.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        placed = placed.join(F.broadcast(inside) if few else inside, F.col("group") == F.col("ig"), "left")
    else:
        placed = placed.withColumn("totals", F.lit(None).cast("array<long>"))
    placed = placed.select("doc_id", "source", "n", "queue", (F.col("base") + F.col("before")).alias("x"), "ids",
                           "group", "member", "totals")
    return _pieces(placed, rounds, window, grain, chunk_ids(path).dtype)


def _pieces(placed: DataFrame, rounds: Rounds, window: int, grain: int, dtype: np.dtype) -> DataFrame:
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [out_id, pa.string(), *[pa.int64()] * 5, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    names = ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    out_id = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal out_id
        inner: dict[int, Rounds] = {}

        def places(queue: int, x: int, n: int, group: int | None, member: int | None, totals: pa.ListScalar):
            if group is None:
                yield from rounds.runs(queue, x, n)
                return
            if group not in inner:
                if len(inner) == 64:
                    inner.clear()
                sizes = totals.values.to_numpy()
                inner[group] = Rounds(sizes, sizes, rounds.round, grain)
            for start, length, place in inner[group].runs(member, x, n):
                for a, m, p in rounds.runs(queue, place, length):
                    yield start + a, m, p

        for batch in slices(batches):
            out_id = batch.schema.field(0).type
            rows = []
            totals = batch.column(8)
            for i, (doc, source, n, queue, x, ids, group, member) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:8]])):
                ids = np.frombuffer(ids, dtype).astype("<u4").tobytes()
                for start, length, place in places(queue, x, n, group, member, totals[i]):
                    while length:
                        seq, offset = divmod(place, window)
                        take = min(length, window - offset)
                        rows.append((doc, source, start, take, n, seq, offset, ids[4 * start:4 * (start + take)]))
                        start, length, place = start + take, length - take, place + take
                if len(rows) >= 20_000:
                    yield flush(rows)
                    rows = []
            if rows:
                yield flush(rows)

    kind = placed.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(
        run, f"doc_id {kind}, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
