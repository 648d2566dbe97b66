"""Sampling intervals and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions._util import as_list, col
from sitewise.functions.dates import days_in_month, month_end, month_start
from sitewise.functions.nulls import r_max, r_mean, r_min, r_sum
from sitewise.operators._window import by_key


def with_interval(df: DataFrame, keys, idx: str = "DATE", out: str = "interval",
                  drop_first: bool = True) -> DataFrame:
    """Days since the previous record of the same series (W1, W9); the first
    record of each series has none and is dropped unless asked."""
    w = by_key(keys, idx)
    df = df.withColumn(out, F.datediff(col(idx), F.lag(idx).over(w)))
    return df.filter(F.col(out).isNotNull()) if drop_first else df


def daily_rate(df: DataFrame, keys, idx: str = "DATE", v: str = "count",
               out: str = "value", max_interval: int | None = None,
               inclusive: bool = True, interval: str = "interval") -> DataFrame:
    """Count divided by the days it accumulated over (W2).  With
    ``max_interval`` records that waited longer are dropped first (W3):
    ``<=`` when ``inclusive``, else ``<``."""
    df = with_interval(df, keys, idx, interval)
    if max_interval is not None:
        c = F.col(interval)
        df = df.filter(c <= max_interval if inclusive else c < max_interval)
    return df.withColumn(out, F.try_divide(col(v), F.col(interval)))


def ceil_rate(df: DataFrame, keys, idx: str = "DATE", v: str = "count",
              out: str = "rate") -> DataFrame:
    """Whole-number share: ceil(count / days since the previous record of
    the series); the first record counts as one day (P18)."""
    w = by_key(keys, idx)
    days = F.coalesce(F.datediff(col(idx), F.lag(idx).over(w)), F.lit(1))
    return df.withColumn(out, F.ceil(F.try_divide(col(v), days)))


def monthly_rate(df: DataFrame, keys, idx: str = "DATE", v: str = "value",
                 out: str = "value", out_idx: str = "date", na_rm: bool = False) -> DataFrame:
    """Sum of daily rates in a month over the days of that month, dated the
    month's last day (G6)."""
    d = month_end(idx)
    return (df.groupBy(*as_list(keys), d.alias(out_idx))
            .agg(r_sum(v, na_rm).alias("_sum"))
            .withColumn(out, F.col("_sum") / days_in_month(out_idx))
            .drop("_sum"))


def monthly_mean_rate(df: DataFrame, keys, idx: str = "DATE", v: str = "VALUE",
                      out: str = "VALUE", na_rm: bool = False) -> DataFrame:
    """Mean daily rate in a month, dated the first (G5, trap form)."""
    return (df.groupBy(*as_list(keys), month_start(idx).alias(idx))
            .agg(r_mean(v, na_rm).alias(out)))


def threshold_report(df: DataFrame, keys, threshold: int, interval: str = "interval") -> DataFrame:
    """What a maximum interval would remove, by key."""
    c = F.col(interval)
    return (df.groupBy(*as_list(keys))
            .agg(F.count(F.lit(1)).alias("nobs"),
                 r_min(interval).alias("interval_min"),
                 r_max(interval).alias("interval_max"),
                 F.count_if(c <= threshold).alias("nlessthresh"))
            .withColumns({
                "percent_kept": 100 * F.col("nlessthresh") / F.col("nobs"),
                "percent_removed": 100 * (F.col("nobs") - F.col("nlessthresh")) / F.col("nobs"),
                "interval_threshold": F.lit(threshold),
            }))


def range_change(df: DataFrame, keys, v: str, keep: Column,
                 names=("thresh_min", "thresh_max", "min", "max")) -> DataFrame:
    """Value range before and after a row filter, by key.

    One aggregate pass instead of two summaries and a join: the "after"
    range is a conditional min/max.  Keys with no row left are dropped, as a
    left join from the filtered summary would do.  As with R's ``min``, a
    null value in the group makes the range null.
    """
    x = col(v)
    kept = F.when(keep, x)
    agg = (df.groupBy(*as_list(keys))
           .agg(F.min(kept).alias(names[0]), F.max(kept).alias(names[1]),
                r_min(v).alias(names[2]), r_max(v).alias(names[3]),
                F.count_if(keep).alias("_n"),
                F.count_if(keep & x.isNull()).alias("_nnull")))
    null_after = F.col("_nnull") > 0
    return (agg.filter(F.col("_n") > 0)
            .withColumns({names[0]: F.when(~null_after, F.col(names[0])),
                          names[1]: F.when(~null_after, F.col(names[1]))})
            .drop("_n", "_nnull"))


def with_active_count(df: DataFrame, site: str = "SITECODE", idx: str = "DATE",
                      out: str = "nactive") -> DataFrame:
    """Number of traps with a record at the same site and day, beside each
    row (W4).  Input is one row per trap and day."""
    return df.withColumn(out, F.count(F.lit(1)).over(by_key([site, idx])))


def max_active(df: DataFrame, site: str = "SITECODE", n: str = "nactive",
               out: str = "max_operational") -> DataFrame:
    """Largest number of traps active together, by site."""
    return df.groupBy(site).agg(F.max(n).alias(out))
