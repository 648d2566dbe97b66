"""Station / trap keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions._util import col


def station_key(site="SITECODE", code="LCODE", sep: str = "-") -> Column:
    """``site<sep>code``; null when either part is null (no "NA" text)."""
    return F.concat(col(site).cast("string"), F.lit(sep), col(code).cast("string"))


def with_station(df: DataFrame, site="SITECODE", code="LCODE", sep: str = "-",
                 out: str = "station") -> DataFrame:
    return df.withColumn(out, station_key(site, code, sep))


def site_of(station, sep: str = "-") -> Column:
    """The site part of a station code (text before the first separator)."""
    return F.substring_index(col(station), sep, 1)
