"""Tables kept bucketed and sorted by their series keys.

A pipeline over such a table needs no exchange: its aggregates and windows by
the keys, or by the keys and more, take the scan's partitioning.  What the
shuffle costs is paid once, when the table is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sitewise.functions._util import as_list


def store_series(df: DataFrame, table: str, keys, idx: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """Write ``df`` as the table ``table``, one file a bucket of ``keys``,
    sorted by keys and ``idx``, and return it.  ``path`` puts the files
    outside the warehouse.  A bucket is read by one task, so ``buckets`` goes
    with the data: some hundred MB each."""
    ks = as_list(keys)
    w = df.repartition(buckets, *ks).write.mode("overwrite").format("parquet").bucketBy(buckets, *ks).sortBy(*ks, idx)
    (w.option("path", path) if path else w).saveAsTable(table)
    return df.sparkSession.table(table)
