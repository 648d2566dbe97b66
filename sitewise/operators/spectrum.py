"""Periodogram of each series.

Per series, ordered by the index: subtract the mean and report
spec = 2/N |X_j|^2 at frequencies j/N, j = 1..floor(N/2), X_j being the
discrete Fourier coefficient (no taper, no padding).  Spark has no transform;
a sum for each coefficient takes N * N / 2 cosines a series, so each series,
whose length its calendar bounds, is transformed by a grouped function in
N log N for every N.  Null values are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewise.functions._util import as_list


def power(x: np.ndarray) -> np.ndarray:
    """Spectrum at j/N, j = 1..floor(N/2)."""
    return 2.0 / len(x) * np.abs(np.fft.rfft(x - x.mean())[1:]) ** 2


def periodogram(df: DataFrame, keys, idx: str, v: str) -> DataFrame:
    """(keys, freq, spec), one row per series and frequency; series of one
    point have none.  Values of one date go in order of size."""
    ks = as_list(keys)
    src = df.select(*ks, F.col(idx).alias("_i"), F.col(v).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in ks]
                          + [T.StructField("freq", T.DoubleType()), T.StructField("spec", T.DoubleType())])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        spec = power(pdf.sort_values(["_i", "_v"])["_v"].to_numpy())
        out = pdf[ks].iloc[np.zeros(len(spec), int)].reset_index(drop=True)
        return out.assign(freq=np.arange(1, n // 2 + 1) / n, spec=spec)

    return src.groupBy(*ks).applyInPandas(one, schema)
