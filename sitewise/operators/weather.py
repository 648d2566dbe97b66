"""Weather of a site for each of its stations, within the station's own
first-last dates (J3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weather_for_stations(weather: DataFrame, obs: DataFrame, types=None, site: str = "SITECODE",
                         station: str = "station", idx: str = "DATE") -> DataFrame:
    """Range join as an equi-join.

    Each station's range is expanded to its months and joined to the weather
    on (site, month), the days then being cut to the range: about thirty
    times fewer rows are shuffled than station-days, the join key is still
    spread over sites *and* months, and AQE can split a skewed one.
    ``types=None`` keeps every weather field.

    The months are dealt to the session's number of shuffle partitions, stated:
    they are few bytes, which AQE would gather in one or two tasks, but each
    becomes some 150 rows of the result.
    """
    w = weather if types is None else weather.filter(F.col("FIELDNAME").isin(list(types)))
    w = w.withColumn("_m", F.trunc(idx, "month"))
    span = obs.groupBy(site, station).agg(F.min(idx).alias("_lo"), F.max(idx).alias("_hi")).filter(F.col("_lo").isNotNull())
    months = span.withColumn("_m", F.explode(F.sequence(F.trunc("_lo", "month"), F.trunc("_hi", "month"), F.expr("interval 1 month"))))
    parts = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (months.repartition(parts, site, "_m").join(w, [site, "_m"], "inner").filter(F.col(idx).between(F.col("_lo"), F.col("_hi")))
            .select(F.col(idx).alias("date"), site, station, F.col("daily").alias("value"),
                    F.col("FIELDNAME").alias("value_type")))
