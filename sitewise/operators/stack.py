"""Tag and stack series of several kinds into one long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack_series(parts: dict) -> DataFrame:
    """``parts``: kind -> (DataFrame, id column or None, index column, value
    column).  Result: (kind, id, index, value); the id is the kind when no
    id column is given.  A plain union: no join, no shuffle."""
    frames = []
    for kind, (df, id_col, idx, v) in parts.items():
        ident = F.col(id_col).cast("string") if id_col else F.lit(kind)
        frames.append(df.select(F.lit(kind).alias("kind"), ident.alias("id"),
                                F.col(idx).cast("date").alias("index"),
                                F.col(v).cast("double").alias("value")))
    return reduce(lambda a, b: a.unionByName(b), frames)
