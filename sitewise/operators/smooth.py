"""Moving averages, differences and fills on a regular series.

The series must be regular (completed first); these are row-based like a
convolution filter.  A weighted sum of ``lag``/``lead`` terms is null as soon
as one term is missing or null, so short ends and gaps give null, as a
convolution filter does; a ``rowsBetween`` average would silently average a
short window instead.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions._util import col
from sitewise.operators._window import ahead, by_key

# Weights of the centred 2x12 moving average (1/24, eleven
# times 1/12, 1/24) and of the trailing 12-step average (twelve times 1/12).
MA_2X12 = [1 / 24] + [1 / 12] * 11 + [1 / 24]
MA_12 = [1 / 12] * 12


def filter_convolution(x, keys, idx: str, weights: list[float], sides: int = 2) -> Column:
    """y[i] = sum_j w[j] * x[i + o - j], o = len(w) // 2 when centred
    (``sides=2``) and 0 when trailing (``sides=1``)."""
    c = col(x)
    w = by_key(keys, idx)
    o = len(weights) // 2 if sides == 2 else 0
    terms = []
    for j, wt in enumerate(weights):
        k = o - j
        term = c if k == 0 else (F.lead(c, k) if k > 0 else F.lag(c, -k)).over(w)
        terms.append(term * F.lit(wt))
    return reduce(add, terms)


def moving_average(df: DataFrame, keys, idx: str, v: str, kind: str = "2x12",
                   out: str | None = None) -> DataFrame:
    """Centred 2x12 (W6) or trailing 12-step (W7) moving average."""
    if kind == "2x12":
        ma, name = filter_convolution(v, keys, idx, MA_2X12, 2), "ma2x12"
    elif kind == "12":
        ma, name = filter_convolution(v, keys, idx, MA_12, 1), "ma12"
    else:
        raise ValueError("kind is '2x12' or '12'")
    return df.withColumn(out or name, ma)


def detrend(df: DataFrame, v: str, ma: str, out: str | None = None) -> DataFrame:
    """Value minus its moving average."""
    return df.withColumn(out or f"detrend_{ma}", col(v) - col(ma))


def seasonal_diff(df: DataFrame, keys, idx: str, v: str, lag: int = 12,
                  out: str = "diff12") -> DataFrame:
    """x(t) - x(t - lag); the first ``lag`` rows are null."""
    return df.withColumn(out, col(v) - F.lag(v, lag).over(by_key(keys, idx)))


def fill_next(df: DataFrame, keys, idx: str, cols: list[str]) -> DataFrame:
    """Replace nulls by the next non-null value of the same series."""
    w = ahead(keys, idx)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
