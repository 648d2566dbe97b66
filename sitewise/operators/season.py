"""Seasonal components, deseasonalising and standardising.

Summaries by (key, calendar month) are window aggregates over
``partitionBy(keys, month)``: the rows are already hash-partitioned by the
keys for the moving average, and that partitioning also serves
(keys, month), so no summary table is joined back and no extra exchange is
planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions._util import as_list, col
from sitewise.functions.nulls import r_mean, r_median, r_sd
from sitewise.operators._window import by_key
from sitewise.operators.smooth import MA_2X12, filter_convolution


def with_month(df: DataFrame, idx: str, out: str = "month") -> DataFrame:
    """Calendar month number."""
    return df.withColumn(out, F.month(idx))


def _mean_over_months(comp: Column, keys, idx: str, month: str,
                      valid: Column | None = None) -> Column:
    """Mean of a per-(key, month) constant over the distinct months of the
    key (not over rows); null when one of them is null.  ``valid`` limits
    the months that take part."""
    ks = as_list(keys)
    first_day = F.min(col(idx) if valid is None else F.when(valid, col(idx))).over(by_key(ks + [month]))
    pick = col(idx) == first_day
    one = F.when(pick, comp)
    w = by_key(ks)
    ok = F.count(F.when(pick, F.lit(1))).over(w) == F.count(one).over(w)
    return F.when(ok, F.avg(one).over(w))


def seasonal_component(df: DataFrame, keys, idx: str, v: str, stat: str = "mean",
                       centre: bool = True, month: str = "month",
                       out: str = "seas_comp", centred_out: str = "std_seas",
                       na_rm: bool = False) -> DataFrame:
    """Monthly mean (or median) of the value by key, and the same minus the
    mean of the monthly values (D2; D5 with ``stat='median'``)."""
    ks = as_list(keys)
    if month not in df.columns:
        df = with_month(df, idx, month)
    wm = by_key(ks + [month])
    agg = r_mean if stat == "mean" else r_median
    df = df.withColumn(out, agg(v, na_rm, w=wm))
    if centre:
        df = df.withColumn(centred_out, col(out) - _mean_over_months(col(out), ks, idx, month))
    return df


def classical_decompose(df: DataFrame, keys, idx: str, v: str) -> DataFrame:
    """Month, 2x12 moving average, detrended value, seasonal component from
    the monthly means of the value, and the deseasoned value (D4, D3).

    The component is estimated from the value itself, not from the
    detrended value; ``deseason_ma`` is the trend-aware form."""
    ks = as_list(keys)
    df = with_month(df, idx)
    df = df.withColumn("ma2x12", filter_convolution(v, ks, idx, MA_2X12, 2))
    df = df.withColumn("detrend_ma2x12", col(v) - col("ma2x12"))
    df = seasonal_component(df, ks, idx, v, out="decomp_seas_comp", centred_out="std_decomp_seas")
    return df.withColumn("decomp_deseason", col(v) - col("std_decomp_seas"))


def deseason_median(df: DataFrame, keys, idx: str, v: str) -> DataFrame:
    """Value minus the centred monthly median."""
    df = seasonal_component(df, keys, idx, v, stat="median", out="median_seas_comp",
                            centred_out="median_std_seas_comp")
    return df.withColumn("deseason", col(v) - col("median_std_seas_comp"))


def deseason_ma(df: DataFrame, keys, idx: str, v: str) -> DataFrame:
    """Trend-aware deseason (D6): component = mean by month of (value - 2x12
    moving average), nulls skipped, not centred; deseason = value -
    component."""
    ks = as_list(keys)
    df = with_month(df, idx)
    df = df.withColumn("ma", filter_convolution(v, ks, idx, MA_2X12, 2))
    df = df.withColumn("detrend_ma", col(v) - col("ma"))
    df = df.withColumn("season_mean", r_mean("detrend_ma", na_rm=True, w=by_key(ks + ["month"])))
    return df.withColumn("deseason", col(v) - col("season_mean"))


def deseason_ma_scaled(df: DataFrame, keys, idx: str, v: str) -> DataFrame:
    """Over rows with a moving average, the monthly mean and sd of the
    detrended value; the mean is centred per key; deseason = (value -
    centred mean) / sd.  Months of a key where no row has a moving average
    are dropped."""
    ks = as_list(keys)
    df = with_month(df, idx)
    df = df.withColumn("ma2x12", filter_convolution(v, ks, idx, MA_2X12, 2))
    df = df.withColumn("detrend_ma2x12", col(v) - col("ma2x12"))
    wm = by_key(ks + ["month"])
    has_ma = col("ma2x12").isNotNull()
    d = F.when(has_ma, col("detrend_ma2x12"))
    df = df.withColumns({
        "_n": F.count(F.when(has_ma, F.lit(1))).over(wm),
        "season_mean": F.avg(d).over(wm),
        "season_sd": F.stddev_samp(d).over(wm),
    }).filter(F.col("_n") > 0)
    df = df.withColumn("season_mean_std",
                       col("season_mean") - _mean_over_months(col("season_mean"), ks, idx, "month"))
    return (df.withColumn("deseason", F.try_divide(col(v) - col("season_mean_std"), col("season_sd")))
            .drop("_n", "season_mean"))


def standardise(df: DataFrame, keys, idx: str, v: str, out: str | None = None,
                month: str = "month") -> DataFrame:
    """(x - mean of the key) / sd of (key, month)."""
    ks = as_list(keys)
    if month not in df.columns:
        df = with_month(df, idx, month)
    sd = r_sd(v, w=by_key(ks + [month]))
    mean = r_mean(v, w=by_key(ks))
    return df.withColumns({f"{v}_sd": sd}).withColumn(
        out or f"{v}_std", F.try_divide(col(v) - mean, col(f"{v}_sd")))


def standardise_month(df: DataFrame, keys, idx: str, v: str, drop_null: bool = True,
                      month: str = "month") -> DataFrame:
    """Month mean of the key out, then divided by the (key, month) sd of
    what is left (D9); rows with a null result are dropped by default."""
    ks = as_list(keys)
    if month not in df.columns:
        df = with_month(df, idx, month)
    wm = by_key(ks + [month])
    df = df.withColumn("avg", r_mean(v, w=wm)).withColumn("deseason", col(v) - col("avg"))
    df = df.withColumn("ssd", r_sd("deseason", w=wm)).withColumn(
        "std", F.try_divide(col("deseason"), col("ssd")))
    return df.filter(col("std").isNotNull()) if drop_null else df


def subseries(df: DataFrame, keys, idx: str, v: str) -> DataFrame:
    """Values by calendar month over the years, with each month's mean."""
    ks = as_list(keys)
    df = df.withColumns({"year": F.year(idx), "month": F.month(idx)})
    return df.withColumn("month_mean", F.avg(v).over(by_key(ks + ["month"])))


def season_table(df: DataFrame, keys, idx: str, v: str) -> DataFrame:
    """One row per key and year, one column per month m01..m12."""
    ks = as_list(keys)
    months = list(range(1, 13))
    wide = (df.withColumn("month", F.month(idx))
            .groupBy(*ks, F.year(idx).alias("year"))
            .pivot("month", months).agg(F.first(v)))
    return wide.withColumnsRenamed({str(m): f"m{m:02d}" for m in months})
