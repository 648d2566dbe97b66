"""Smoothing and seasonal queries: W5-W11, D1-D5, D7-D11."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions.nulls import r_sd
from sitewise.operators._window import by_key
from sitewise.operators.calendar import complete_months
from sitewise.operators.rates import with_interval
from sitewise.operators.season import (classical_decompose, deseason_ma_scaled, deseason_median,
                                       season_table, seasonal_component, standardise,
                                       subseries)
from sitewise.operators.smooth import detrend, fill_next, moving_average, seasonal_diff
from sitewise.plans import station as st
from sitewise.plans import trap
from sitewise.plans.catalog.common import clean, site_monthly
from sitewise.plans.registry import r6, register
from sitewise.plans.sqlparts import (CLEAN, DAILY, DRATE, MRATE, OBS, calendar_sql, with_)

SMON = """smon0 AS (SELECT SITECODE, date_trunc('month', DATE)::DATE AS DATETIME,
                   coalesce(sum(VALUE), 0) AS counts FROM clean GROUP BY ALL),
scal AS (""" + calendar_sql("smon0", ["SITECODE"], "DATETIME") + """),
smon AS (SELECT c.SITECODE, c.DATETIME, coalesce(m.counts, 0) AS counts
         FROM scal c LEFT JOIN smon0 m USING (SITECODE, DATETIME))"""
BS = with_(OBS, CLEAN, SMON) + "\n"
K = ["SITECODE"]


_AT = "OVER (PARTITION BY SITECODE ORDER BY DATETIME"
# Moving averages as SQL frames: 12 whole months and half of the two ends;
# the 12 months up to and with this one.  Null unless every month is there.
MA = f"""(CASE WHEN count(counts) {_AT} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN
  (sum(counts) {_AT} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
   + 0.5 * lag(counts, 6) {_AT}) + 0.5 * lead(counts, 6) {_AT})) / 12.0 END)"""
MA12 = f"""(CASE WHEN count(counts) {_AT} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) = 12 THEN
  avg(counts) {_AT} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) END)"""


@register("w5_seasonal_diff", BS + f"""SELECT SITECODE, DATETIME, {r6('counts')},
  {r6('counts - lag(counts, 12) OVER (PARTITION BY SITECODE ORDER BY DATETIME)', 'diff12')} FROM smon""")
def w5_seasonal_diff(spark, d):
    return seasonal_diff(site_monthly(spark, d), K, "DATETIME", "counts")


@register("w6_ma2x12", BS + f"SELECT SITECODE, DATETIME, {r6('counts')}, {r6(MA, 'ma2x12')} FROM smon")
def w6_ma2x12(spark, d):
    """Centred 2x12 moving average of the monthly total per site."""
    return moving_average(site_monthly(spark, d), K, "DATETIME", "counts", "2x12")


@register("w7_ma12", BS + f"SELECT SITECODE, DATETIME, {r6('counts')}, {r6(MA12, 'ma12')} FROM smon")
def w7_ma12(spark, d):
    return moving_average(site_monthly(spark, d), K, "DATETIME", "counts", "12")


@register("w8_detrend", BS + f"""SELECT SITECODE, DATETIME, {r6('counts - ' + MA, 'detrend_ma2x12')},
  {r6('counts - ' + MA12, 'detrend_ma12')} FROM smon""")
def w8_detrend(spark, d):
    df = moving_average(site_monthly(spark, d), K, "DATETIME", "counts", "2x12")
    df = moving_average(df, K, "DATETIME", "counts", "12")
    df = detrend(detrend(df, "counts", "ma2x12"), "counts", "ma12")
    return df.select("SITECODE", "DATETIME", "detrend_ma2x12", "detrend_ma12")


@register("w9_regularity", BS + """SELECT SITECODE, DATETIME,
  date_diff('day', lag(DATETIME) OVER (PARTITION BY SITECODE ORDER BY DATETIME), DATETIME) AS "interval"
FROM smon""")
def w9_regularity(spark, d):
    """Days between consecutive rows of the completed series (a check that
    the series is regular); the first row has none."""
    return with_interval(site_monthly(spark, d), K, "DATETIME", drop_first=False).drop("counts")


_MC = with_(OBS, CLEAN, DAILY, DRATE, MRATE) + ", mcal AS (" + calendar_sql(
    "mrate", ["SITECODE", "station", "value_type"], "date", anchor="end") + """),
mfull AS (SELECT c.*, m.value FROM mcal c LEFT JOIN mrate m USING (SITECODE, station, value_type, date))
"""


@register("w10_fill_next", _MC + f"""SELECT SITECODE, station, value_type, date,
  {r6('first_value(value IGNORE NULLS) OVER (PARTITION BY SITECODE, station, value_type ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)', 'value')}
FROM mfull""")
def w10_fill_next(spark, d):
    """Months completed at month ends; a missing rate takes the next one."""
    keys = ["SITECODE", "station", "value_type"]
    full = complete_months(st.monthly_abundance_rate(clean(spark, d)), keys, "date", anchor="end")
    return fill_next(full, keys, "date", ["value"])


@register("w11_group_sd", BS + f"""SELECT SITECODE, DATETIME, {r6('counts')},
  {r6('CASE WHEN count(counts) OVER w = count(*) OVER w THEN stddev_samp(counts) OVER w END', 'month_sd')}
FROM smon WINDOW w AS (PARTITION BY SITECODE, month(DATETIME))""")
def w11_group_sd(spark, d):
    """Standard deviation of the site's values in the same calendar month."""
    df = site_monthly(spark, d)
    return df.withColumn("month_sd", r_sd("counts", w=by_key(K + [F.month("DATETIME")])))


def _comp_sql(agg: str, comp: str, cent: str) -> str:
    return f""", comp AS (
  SELECT SITECODE, month(DATETIME) AS month,
         CASE WHEN count(counts) = count(*) THEN {agg}(counts) END AS {comp}
  FROM smon GROUP BY ALL),
cc AS (SELECT *, {comp} - CASE WHEN count({comp}) OVER (PARTITION BY SITECODE) = count(*) OVER (PARTITION BY SITECODE)
                              THEN avg({comp}) OVER (PARTITION BY SITECODE) END AS {cent} FROM comp),
dec AS (SELECT s.*, cc.month, cc.{comp}, cc.{cent} FROM smon s JOIN cc ON s.SITECODE = cc.SITECODE
        AND month(s.DATETIME) = cc.month)
"""


@register("d2_seasonal_component", BS + _comp_sql("avg", "seas_comp", "std_seas") +
          f"SELECT SITECODE, DATETIME, {r6('counts')}, month, {r6('seas_comp')}, {r6('std_seas')} FROM dec")
def d2_seasonal_component(spark, d):
    """Monthly mean by site, and the same centred on the mean of the months."""
    return seasonal_component(site_monthly(spark, d), K, "DATETIME", "counts")


@register("d3_deseason_mean", BS + _comp_sql("avg", "seas_comp", "std_seas") +
          f"SELECT SITECODE, DATETIME, {r6('counts - std_seas', 'decomp_deseason')} FROM dec")
def d3_deseason_mean(spark, d):
    return (classical_decompose(site_monthly(spark, d), K, "DATETIME", "counts")
            .select("SITECODE", "DATETIME", "decomp_deseason"))


DEC_COLS = ["ma2x12", "detrend_ma2x12", "decomp_seas_comp", "std_decomp_seas", "decomp_deseason"]
_DEC_SQL = BS + _comp_sql("avg", "decomp_seas_comp", "std_decomp_seas") + f""",
dec2 AS (SELECT *, {MA} AS ma2x12 FROM dec),
dec3 AS (SELECT *, counts - ma2x12 AS detrend_ma2x12, counts - std_decomp_seas AS decomp_deseason FROM dec2)
"""


@register("d4_classical_decompose", _DEC_SQL + "SELECT SITECODE, DATETIME, month, " +
          ", ".join(r6(c) for c in ["counts"] + DEC_COLS) + " FROM dec3")
def d4_classical_decompose(spark, d):
    """Month, 2x12 MA, detrended value, component, deseasoned value."""
    return classical_decompose(site_monthly(spark, d), K, "DATETIME", "counts")


@register("d5_deseason_median", BS + _comp_sql("median", "median_seas_comp", "median_std_seas_comp") +
          f"""SELECT SITECODE, DATETIME, month, {r6('counts')}, {r6('median_seas_comp')},
  {r6('median_std_seas_comp')}, {r6('counts - median_std_seas_comp', 'deseason')} FROM dec""")
def d5_deseason_median(spark, d):
    return deseason_median(site_monthly(spark, d), K, "DATETIME", "counts")


@register("d7_deseason_ma_scaled", BS + f""", m AS (
  SELECT *, month(DATETIME) AS month, {MA} AS ma2x12 FROM smon),
m2 AS (SELECT *, counts - ma2x12 AS detrend_ma2x12 FROM m),
sc AS (SELECT SITECODE, month, avg(detrend_ma2x12) AS season_mean, stddev_samp(detrend_ma2x12) AS season_sd
       FROM m2 WHERE ma2x12 IS NOT NULL GROUP BY ALL),
sc2 AS (SELECT *, season_mean - avg(season_mean) OVER (PARTITION BY SITECODE) AS season_mean_std FROM sc)
SELECT m2.SITECODE, m2.DATETIME, m2.month, {r6('counts')}, {r6('ma2x12')}, {r6('detrend_ma2x12')},
  {r6('season_sd')}, {r6('season_mean_std')}, {r6('(counts - season_mean_std) / season_sd', 'deseason')}
FROM m2 JOIN sc2 USING (SITECODE, month)""")
def d7_deseason_ma_scaled(spark, d):
    """Trend-aware component centred per site and scaled by the month's sd."""
    return deseason_ma_scaled(site_monthly(spark, d), K, "DATETIME", "counts")


@register("d8_standardise", _DEC_SQL + f""", st AS (
  SELECT *, CASE WHEN count(decomp_deseason) OVER m = count(*) OVER m THEN stddev_samp(decomp_deseason) OVER m END AS decomp_deseason_sd,
         CASE WHEN count(decomp_deseason) OVER s = count(*) OVER s THEN avg(decomp_deseason) OVER s END AS site_mean
  FROM dec3 WINDOW m AS (PARTITION BY SITECODE, month), s AS (PARTITION BY SITECODE))
SELECT SITECODE, DATETIME, {r6('decomp_deseason')}, {r6('decomp_deseason_sd')},
  {r6('(decomp_deseason - site_mean) / decomp_deseason_sd', 'decomp_deseason_std')} FROM st""")
def d8_standardise(spark, d):
    """Deseasoned value standardised by site mean and (site, month) sd."""
    df = classical_decompose(site_monthly(spark, d), K, "DATETIME", "counts")
    return (standardise(df, K, "DATETIME", "decomp_deseason")
            .select("SITECODE", "DATETIME", "decomp_deseason", "decomp_deseason_sd", "decomp_deseason_std"))


_TRAP_M = with_(OBS, CLEAN, DAILY, DRATE) + """, drt AS (SELECT station AS TRAPCODE, DATE, value AS VALUE
  FROM drate WHERE "interval" <= 5),
tm AS (SELECT TRAPCODE, date_trunc('month', DATE)::DATE AS DATE,
              CASE WHEN count(VALUE) = count(*) THEN avg(VALUE) END AS VALUE FROM drt GROUP BY ALL)
"""


TRAP_STD = _TRAP_M + """, t2 AS (
  SELECT *, month(DATE) AS month,
         CASE WHEN count(VALUE) OVER w = count(*) OVER w THEN avg(VALUE) OVER w END AS avg
  FROM tm WINDOW w AS (PARTITION BY TRAPCODE, month(DATE))),
t3 AS (SELECT *, VALUE - avg AS deseason FROM t2),
t4 AS (SELECT *, CASE WHEN count(deseason) OVER w = count(*) OVER w THEN stddev_samp(deseason) OVER w END AS ssd
       FROM t3 WINDOW w AS (PARTITION BY TRAPCODE, month))
"""


@register("d9_standardise_month", TRAP_STD + f"""
SELECT TRAPCODE, DATE, month, {r6('VALUE')}, {r6('avg')}, {r6('deseason')}, {r6('ssd')}, {r6('deseason / ssd', 'std')}
FROM t4 WHERE deseason / ssd IS NOT NULL""")
def d9_standardise_month(spark, d):
    """Monthly trap rate: month mean out, divided by the month's sd."""
    return trap.trap_standardised(clean(spark, d), max_interval=5)


@register("d10_subseries", BS + f"""SELECT SITECODE, DATETIME, year(DATETIME) AS year, month(DATETIME) AS month,
  {r6('counts')}, {r6('avg(counts) OVER (PARTITION BY SITECODE, month(DATETIME))', 'month_mean')} FROM smon""")
def d10_subseries(spark, d):
    return subseries(site_monthly(spark, d), K, "DATETIME", "counts")


_MONTH_COLS = ",\n  ".join(r6(f"max(counts) FILTER (WHERE month(DATETIME) = {m})", f"m{m:02d}") for m in range(1, 13))


@register("d11_season_table", BS + f"SELECT SITECODE, year(DATETIME) AS year, {_MONTH_COLS} FROM smon GROUP BY SITECODE, year(DATETIME)")
def d11_season_table(spark, d):
    """One row per site and year, one column per month."""
    return season_table(site_monthly(spark, d), K, "DATETIME", "counts")
