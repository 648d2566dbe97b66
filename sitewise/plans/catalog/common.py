"""Inputs shared by the driver queries (Spark side of ``sqlparts``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitewise.operators.counts import daily_counts
from sitewise.sources import standin
from sitewise.sources.readers import clean_observations


def obs(spark: SparkSession, d: str) -> DataFrame:
    return standin.observations(spark, d)


def clean(spark: SparkSession, d: str) -> DataFrame:
    return clean_observations(standin.observations(spark, d))


def daily(spark: SparkSession, d: str) -> DataFrame:
    return daily_counts(clean(spark, d), ["SITECODE", "station"], "DATE", "VALUE", out="count")


def monthly_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Monthly count per station and functional group (series with missing
    months): observations joined to groups, nulls dropped."""
    from pyspark.sql import functions as F

    from sitewise.functions.dates import month_start
    from sitewise.operators.enrich import enrich
    e = enrich(clean(spark, d), standin.groups(spark, d), how="inner")
    return (e.groupBy("station", "IM_GROUP", month_start("DATE").alias("DATETIME"))
            .agg(F.sum("VALUE").alias("counts")))


def site_monthly(spark: SparkSession, d: str) -> DataFrame:
    """Monthly total per site (nulls skipped), every month present (missing
    months 0): the regular series for smoothing and seasonal work."""
    from pyspark.sql import functions as F

    from sitewise.functions.dates import month_start
    from sitewise.functions.nulls import r_sum
    from sitewise.operators.calendar import complete_months
    m = (clean(spark, d).groupBy("SITECODE", month_start("DATE").alias("DATETIME"))
         .agg(r_sum("VALUE", na_rm=True).alias("counts")))
    return complete_months(m, ["SITECODE"], "DATETIME", fill={"counts": 0})
