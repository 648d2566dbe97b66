"""Trap pipeline: daily count per trap -> interval to the previous emptying ->
records that waited too long dropped -> daily rate -> monthly mean rate ->
month-standardised series, optionally stacked with daily weather of the
sites for a joint changepoint fit.

Same partitioning story as the station pipeline: one shuffle for the daily
count, one for the trap windows; the monthly steps reuse the latter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.keys import site_of
from sitewise.operators.counts import daily_counts
from sitewise.operators.filters import between_dates, filter_in
from sitewise.operators.rates import daily_rate, monthly_mean_rate
from sitewise.operators.season import standardise_month
from sitewise.operators.stack import stack_series

# The largest interval between emptyings kept by default (days).
MAX_INTERVAL = 5


def trap_daily_counts(clean: DataFrame, traps=None, lo=None, hi=None,
                      trap: str = "station") -> DataFrame:
    """Count per trap and day, as (TRAPCODE, DATE, VALUE)."""
    df = between_dates(clean, "DATE", lo, hi)
    if traps is not None:
        df = filter_in(df, trap, traps)
    return (daily_counts(df, [trap], "DATE", "VALUE", out="VALUE")
            .withColumnRenamed(trap, "TRAPCODE"))


def trap_daily_rate(counts: DataFrame, max_interval: int | None = MAX_INTERVAL,
                    inclusive: bool = True) -> DataFrame:
    """Rate per day since the previous emptying; records after a longer
    wait are dropped (``<=`` or ``<`` the threshold)."""
    return (daily_rate(counts, ["TRAPCODE"], "DATE", "VALUE", out="VALUE",
                       max_interval=max_interval, inclusive=inclusive)
            .select("TRAPCODE", "DATE", "VALUE", "interval"))


def trap_monthly(rate: DataFrame) -> DataFrame:
    """Mean daily rate per trap and month, dated the first."""
    return monthly_mean_rate(rate, ["TRAPCODE"], "DATE", "VALUE")


def trap_standardised(clean: DataFrame, traps=None, lo=None, hi=None,
                      max_interval: int | None = MAX_INTERVAL, inclusive: bool = True) -> DataFrame:
    """The whole chain: month mean out, divided by the month's sd; rows
    without a result are dropped."""
    rate = trap_daily_rate(trap_daily_counts(clean, traps, lo, hi), max_interval, inclusive)
    return standardise_month(trap_monthly(rate), ["TRAPCODE"], "DATE", "VALUE")


def with_site_weather(std: DataFrame, weather: DataFrame, field: str | None = None, lo=None, hi=None) -> DataFrame:
    """Standardised trap series stacked with the daily weather of the sites,
    ready for a joint fit of series of different sampling rate: one field
    (id = site code), or every field (id = ``site/field``)."""
    w = between_dates(weather.filter(F.col("daily").isNotNull()), "DATE", lo, hi)
    w = w.filter(F.col("FIELDNAME") == field) if field is not None else w.withColumn("SITECODE", F.concat_ws("/", "SITECODE", "FIELDNAME"))
    return stack_series({"trap": (std, "TRAPCODE", "DATE", "std"),
                         "weather": (w, "SITECODE", "DATE", "daily")})


def site_of_series(kind="kind", ident="id") -> Column:
    """Site of a stacked series: before the ``-`` of a trap code or the ``/``
    of a weather id."""
    return F.when(F.col(kind) == "trap", site_of(ident)).otherwise(F.substring_index(ident, "/", 1))
