"""Station pipeline: daily rate -> monthly rate -> interpolation -> deseason.

One scan of the observations; every step after the daily count is
partitioned by station, so the plan has one exchange for the daily sum
(after its partial aggregate) and one for the station windows, which every
later step reuses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.operators.calendar import interpolate_linear
from sitewise.operators.counts import daily_counts
from sitewise.operators.filters import between_dates, filter_in
from sitewise.operators.rates import daily_rate, monthly_rate
from sitewise.operators.season import deseason_ma

KEYS = ["SITECODE", "station"]


def daily_abundance_rate(clean: DataFrame, stations=None, date_min=None,
                         date_max=None) -> DataFrame:
    """Count per station and day, over the days since the station's previous
    record; a station's first record is dropped."""
    df = between_dates(clean, "DATE", date_min, date_max)
    if stations is not None:
        df = filter_in(df, "station", stations)
    daily = daily_counts(df, ["SITECODE", "station"], "DATE", "VALUE", out="count")
    return (daily_rate(daily, ["station"], "DATE", "count", out="value")
            .select("SITECODE", "DATE", "station", "value",
                    F.lit("daily_abun_rate").alias("value_type")))


def monthly_abundance_rate(clean: DataFrame, stations=None, date_min=None,
                           date_max=None) -> DataFrame:
    daily = daily_abundance_rate(clean, stations, date_min, date_max)
    return (monthly_rate(daily, KEYS, "DATE", "value", out="value", out_idx="date")
            .withColumn("value_type", F.lit("monthly_abun_rate")))


def interpolated_monthly(monthly: DataFrame) -> DataFrame:
    return interpolate_linear(monthly, KEYS + ["value_type"], "date", "value")


def deseasoned_monthly(monthly: DataFrame) -> DataFrame:
    return deseason_ma(interpolated_monthly(monthly), ["station"], "date", "value")
