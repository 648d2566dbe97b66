from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sitewise.functions._util import as_list


def by_key(keys, idx: str | None = None) -> WindowSpec:
    """Window over one series: partitioned by its keys, ordered by the index.

    An empty key list is refused: an unpartitioned window pulls the whole
    table into one task.
    """
    ks = as_list(keys)
    if not ks:
        raise ValueError("a series window needs at least one key column")
    w = Window.partitionBy(*ks)
    return w.orderBy(idx) if idx is not None else w


def running(keys, idx: str) -> WindowSpec:
    return by_key(keys, idx).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ahead(keys, idx: str) -> WindowSpec:
    """Rows from the current one to the end of the series, as a running
    frame in descending order: ``last(x, ignorenulls)`` over it is the next
    non-null value.  (A frame up to UNBOUNDED FOLLOWING is recomputed for
    every row, O(n^2) per series; a running frame is O(n).)"""
    ks = as_list(keys)
    if not ks:
        raise ValueError("a series window needs at least one key column")
    return (Window.partitionBy(*ks).orderBy(F.col(idx).desc())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))


def after(keys, idx: str) -> WindowSpec:
    """``ahead`` without the current row."""
    return ahead(keys, idx).rowsBetween(Window.unboundedPreceding, -1)


def whole(keys, idx: str) -> WindowSpec:
    return by_key(keys, idx).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def dealt(df: DataFrame, keys) -> DataFrame:
    """The rows dealt by series to the session's number of shuffle partitions,
    stated: AQE would gather small shuffled bytes in as many tasks as there
    are cores, and each of them then holds the sorts of all its series."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *as_list(keys))
