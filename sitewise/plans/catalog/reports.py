"""Count, interval and rate reports: G3, G5, G7-G18, W3, W4, P18."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sitewise.operators.counts import (daily_counts, daily_species, date_bounds, month_medians,
                                       monthly_mean, pivot_fields, series_mean, species_by_trap,
                                       species_by_trap_slices, trap_columns, value_range)
from sitewise.operators.rates import (ceil_rate, max_active, range_change, threshold_report,
                                      with_active_count, with_interval)
from sitewise.plans import station as st
from sitewise.plans import trap
from sitewise.plans.catalog.common import clean, daily, obs
from sitewise.plans.registry import r6, register
from sitewise.plans.sqlparts import (CLEAN, DAILY, DRATE, MRATE, OBS, TRAITS, WEATHER, with_)
from sitewise.sources import standin
from sitewise.sources.readers import trim_trait_code

BC = with_(OBS, CLEAN)
BD = with_(OBS, CLEAN, DAILY, DRATE)
BM = with_(OBS, CLEAN, DAILY, DRATE, MRATE)

# The interval threshold of the trap pipeline (days).
THRESHOLD = 5
# Site codes of the stand-in: one per nation key 0..24.
SITES = [f"T{i:02d}" for i in range(25)]
# Weather fields of the stand-in (order priorities).
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("g3_daily_species", BC + f"""SELECT station, DATE, {r6('counts')},
  CASE WHEN counts = 0 THEN 0 ELSE n END AS n_species
FROM (SELECT station, DATE, coalesce(sum(VALUE), 0) AS counts,
             count(DISTINCT FIELDNAME) + max(CASE WHEN FIELDNAME IS NULL THEN 1 ELSE 0 END) AS n
      FROM clean GROUP BY station, DATE)""")
def g3_daily_species(spark, d):
    return daily_species(clean(spark, d), ["station"], "DATE")


_RATE_T = BD + """, drt AS (SELECT station AS TRAPCODE, DATE, value AS VALUE, "interval"
  FROM drate WHERE "interval" {op} """ + str(THRESHOLD) + ")\n"


def _trap_rate(spark, d, inclusive=True):
    return trap.trap_daily_rate(trap.trap_daily_counts(clean(spark, d)), THRESHOLD, inclusive)


@register("w3_daily_rate_threshold", _RATE_T.format(op="<=") +
          f"SELECT TRAPCODE, DATE, {r6('VALUE')}, \"interval\"::BIGINT AS \"interval\" FROM drt")
def w3_daily_rate_threshold(spark, d):
    """Daily rate after dropping records that waited more than 5 days."""
    return _trap_rate(spark, d, True)


@register("w3_daily_rate_threshold_lt", _RATE_T.format(op="<") +
          f"SELECT TRAPCODE, DATE, {r6('VALUE')}, \"interval\"::BIGINT AS \"interval\" FROM drt")
def w3_daily_rate_threshold_lt(spark, d):
    """Same with a strict threshold (the other form in the field scripts)."""
    return _trap_rate(spark, d, False)


@register("g5_monthly_mean_rate", _RATE_T.format(op="<=") + f"""SELECT TRAPCODE,
  date_trunc('month', DATE)::DATE AS DATE,
  {r6('CASE WHEN count(VALUE) = count(*) THEN avg(VALUE) END', 'VALUE')}
FROM drt GROUP BY TRAPCODE, date_trunc('month', DATE)""")
def g5_monthly_mean_rate(spark, d):
    """Mean daily rate per trap and month, dated the first."""
    return trap.trap_monthly(_trap_rate(spark, d))


@register("g5_weather_monthly", with_(WEATHER) + f"""SELECT SITECODE, FIELDNAME,
  date_trunc('month', DATE)::DATE AS yearmonth, {r6('avg(daily)', 'monthly_avg')}
FROM weather GROUP BY SITECODE, FIELDNAME, date_trunc('month', DATE)""")
def g5_weather_monthly(spark, d):
    """Monthly mean of a daily weather value, nulls skipped."""
    return monthly_mean(standin.weather(spark, d), ["SITECODE", "FIELDNAME"], "DATE", "daily",
                        na_rm=True, out="monthly_avg", out_idx="yearmonth")


@register("g7_value_range", BD + f"""SELECT station, {r6('CASE WHEN count(count) = count(*) THEN min(count) END', 'min')},
  {r6('CASE WHEN count(count) = count(*) THEN max(count) END', 'max')} FROM daily GROUP BY station""")
def g7_value_range(spark, d):
    return value_range(daily(spark, d), ["station"], "count")


@register("g8_interval_range", BD + """SELECT station, min("interval")::BIGINT AS interval_min,
  max("interval")::BIGINT AS interval_max FROM drate GROUP BY station""")
def g8_interval_range(spark, d):
    return value_range(with_interval(daily(spark, d), ["station"], "DATE"), ["station"], "interval",
                       lo="interval_min", hi="interval_max")


@register("g9_threshold_report", BD + f"""SELECT station, count(*) AS nobs,
  min("interval")::BIGINT AS interval_min, max("interval")::BIGINT AS interval_max,
  count(*) FILTER (WHERE "interval" <= {THRESHOLD}) AS nlessthresh,
  {r6(f'100.0 * count(*) FILTER (WHERE "interval" <= {THRESHOLD}) / count(*)', 'percent_kept')},
  {r6(f'100.0 * (count(*) - count(*) FILTER (WHERE "interval" <= {THRESHOLD})) / count(*)', 'percent_removed')},
  {THRESHOLD}::BIGINT AS interval_threshold
FROM drate GROUP BY station""")
def g9_threshold_report(spark, d):
    return threshold_report(with_interval(daily(spark, d), ["station"], "DATE"), ["station"], THRESHOLD)


@register("g10_range_change", BD + f"""SELECT a.station, {r6('a.thresh_min', 'thresh_min')},
  {r6('a.thresh_max', 'thresh_max')}, {r6('b.min', 'min')}, {r6('b.max', 'max')}
FROM (SELECT station, CASE WHEN count(count) = count(*) THEN min(count) END AS thresh_min,
             CASE WHEN count(count) = count(*) THEN max(count) END AS thresh_max
      FROM drate WHERE "interval" < {THRESHOLD} GROUP BY station) a
LEFT JOIN (SELECT station, CASE WHEN count(count) = count(*) THEN min(count) END AS min,
                  CASE WHEN count(count) = count(*) THEN max(count) END AS max
           FROM drate GROUP BY station) b USING (station)""")
def g10_range_change(spark, d):
    """Count range per station before and after the interval threshold."""
    iv = with_interval(daily(spark, d), ["station"], "DATE")
    return range_change(iv, ["station"], "count", F.col("interval") < THRESHOLD)


@register("g11_date_bounds", BC + "SELECT station, min(DATE) AS date_min, max(DATE) AS date_max FROM clean GROUP BY station")
def g11_date_bounds(spark, d):
    return date_bounds(clean(spark, d), ["station"], "DATE")


_ACTIVE = BC + """, act AS (
  SELECT SITECODE, LCODE, DATE, CASE WHEN count(VALUE) = count(*) THEN sum(VALUE) END AS VALUE,
         count(*) OVER (PARTITION BY SITECODE, DATE) AS nactive
  FROM clean GROUP BY SITECODE, LCODE, DATE)
"""


def _active(spark, d):
    per_trap = daily_counts(clean(spark, d), ["SITECODE", "LCODE"], "DATE", "VALUE", out="VALUE")
    return with_active_count(per_trap, "SITECODE", "DATE")


@register("w4_active_count", _ACTIVE + f"SELECT SITECODE, LCODE, DATE, {r6('VALUE')}, nactive FROM act")
def w4_active_count(spark, d):
    """Traps with a record at the same site on the same day."""
    return _active(spark, d)


@register("g12_max_active", _ACTIVE + "SELECT SITECODE, max(nactive) AS max_operational FROM act GROUP BY SITECODE")
def g12_max_active(spark, d):
    return max_active(_active(spark, d))


_PIVOT = ",\n  ".join(f"nullif(count(*) FILTER (WHERE SITECODE = '{s}'), 0) AS {s}" for s in SITES)
_PIVOT += ",\n  nullif(count(*) FILTER (WHERE SITECODE NOT IN (" + ", ".join(f"'{s}'" for s in SITES) + ")), 0) AS other"


@register("g13_species_by_trap", with_(OBS, TRAITS) + f"""SELECT w.*, t.Genus, t.species, t.COMMON_NAME, t.Family
FROM (SELECT FIELDNAME, {_PIVOT} FROM obs GROUP BY FIELDNAME) w
LEFT JOIN traits t ON w.FIELDNAME = t.IM_CODE""")
def g13_species_by_trap(spark, d):
    """Rows per field name and site, one column per site, with trait names."""
    traits = trim_trait_code(standin.raw_traits(spark, d))
    return species_by_trap(obs(spark, d), SITES, traits, trap="SITECODE")


@register("g13_species_by_each_trap", with_(OBS) + """, counted AS (SELECT FIELDNAME, 'trap_' || LCODE AS trap FROM obs)
SELECT * FROM (PIVOT counted ON trap USING count(*) GROUP BY FIELDNAME)""")
def g13_species_by_each_trap(spark, d):
    """Rows per field name and trap, one column per trap, the columns taken
    from the table of traps."""
    traps = standin.table(spark, d, "supplier").select(F.col("s_suppkey").alias("TRAP"))
    names = trap_columns(traps, prefix="trap_")
    o = obs(spark, d).withColumn("TRAP", F.concat(F.lit("trap_"), F.col("LCODE").cast("string")))
    [wide] = species_by_trap_slices(o, names, width=len(names), fill=0, other=False)
    return wide


def _safe(name: str) -> str:
    return "f_" + re.sub(r"[^0-9A-Za-z]+", "_", name)


_WPIV = ",\n  ".join(f"{r6(f'max(daily) FILTER (WHERE FIELDNAME = {chr(39)}{p}{chr(39)})', _safe(p))}"
                     for p in PRIORITIES)
_WPIV += ",\n  count(*) FILTER (WHERE FIELDNAME NOT IN (" + ", ".join(f"'{p}'" for p in PRIORITIES) + ")) AS n_other"


@register("g14_pivot_fields", with_(WEATHER) + f"SELECT SITECODE, DATE, {_WPIV} FROM weather GROUP BY SITECODE, DATE")
def g14_pivot_fields(spark, d):
    """Weather fields from long to wide, one column per field."""
    wide = pivot_fields(standin.weather(spark, d), ["SITECODE", "DATE"], "FIELDNAME", "daily", PRIORITIES)
    return wide.withColumnsRenamed({p: _safe(p) for p in PRIORITIES})


@register("g15_distinct", BC + "SELECT DISTINCT SITECODE, FIELDNAME FROM clean")
def g15_distinct(spark, d):
    return clean(spark, d).select("SITECODE", "FIELDNAME").distinct()


@register("g16_series_mean", BM + f"SELECT station, {r6('avg(value)', 'level')} FROM mrate GROUP BY station")
def g16_series_mean(spark, d):
    """Overall level of the monthly rate per station."""
    return series_mean(st.monthly_abundance_rate(clean(spark, d)), ["station"], "value")


@register("g18_month_median", BM + f""", med AS (
  SELECT station, month(date) AS month,
         CASE WHEN count(value) = count(*) THEN median(value) END AS median_month
  FROM mrate GROUP BY station, month(date))
SELECT station, month, {r6('median_month')},
  {r6('CASE WHEN count(median_month) OVER (PARTITION BY station) = count(*) OVER (PARTITION BY station) THEN avg(median_month) OVER (PARTITION BY station) END', 'mean_of_medians')}
FROM med""")
def g18_month_median(spark, d):
    """Median monthly rate by calendar month, and the mean of the medians."""
    return month_medians(st.monthly_abundance_rate(clean(spark, d)), ["station"], "date", "value")


@register("p18_ceil_rate", BD + """SELECT station, DATE,
  CAST(ceil(count / coalesce(date_diff('day', lag(DATE) OVER (PARTITION BY station ORDER BY DATE), DATE), 1)) AS BIGINT) AS rate
FROM daily""")
def p18_ceil_rate(spark, d):
    """Whole-number share of a count over the days since the last record."""
    return ceil_rate(daily(spark, d), ["station"], "DATE", "count").select("station", "DATE", "rate")
