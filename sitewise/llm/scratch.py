"""Tables that cut lineage, joins with a checked broadcast, and other small
helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a broadcast side may have.  The broadcast tables of this package have
# a few numbers a row, so this bounds a broadcast to some tens of MB.
BROADCAST_ROWS = 300_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where the setting is missing, a folder set on the context is used; a
    local session (tests) gets a temporary one; a cluster is refused."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        d = tempfile.mkdtemp(prefix="sitewise-scratch-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it: a
    lost executor later recomputes from there.  ``codec``: compression of the
    files, the session's if not given."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    for made in _open:
        made.append(out)
    return out


_open: list[list[DataFrame]] = []


@contextmanager
def tables():
    """A list of the tables that ``materialise`` writes inside the block, to
    be dropped once nothing reads them any more."""
    made: list[DataFrame] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open[:] = [x for x in _open if x is not made]


def drop(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows it is within ``rows``;
    beyond that the join is left to shuffle.  ``df`` should be materialised."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1000):
    """Inside the block, what runs gives Python at most ``rows`` rows at a
    time.  A batch of whole texts is held by the executor and by its Python
    worker, and the session's size is meant for rows of a few numbers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    few = int(usual) <= 0 or int(usual) > rows
    if few:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if few:
            spark.conf.set(name, usual)


def slices(batches, rows: int = 256):
    """Arrow batches cut into smaller ones, so that what a task holds in
    Python at a time does not go with the session's batch size."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
