"""Station pipeline queries: G1, W1, W2, G6, C3, C5, D6."""

from __future__ import annotations

from sitewise.operators.calendar import complete_months
from sitewise.operators.rates import with_interval
from sitewise.plans import station as st
from sitewise.plans.catalog.common import clean, daily
from sitewise.plans.registry import r6, register
from sitewise.plans.sqlparts import CLEAN, DAILY, DRATE, MRATE, OBS, calendar_sql, with_

BASE = with_(OBS, CLEAN, DAILY, DRATE, MRATE)

# Interpolated monthly rate (C5) as SQL: month-end calendar per station,
# nearest non-null month on each side, straight line on the day axis.
INTERP = "cal AS (" + calendar_sql("mrate", ["SITECODE", "station", "value_type"], "date", anchor="end") + """),
fullm AS (SELECT c.SITECODE, c.station, c.value_type, c.date, m.value
         FROM cal c LEFT JOIN mrate m USING (SITECODE, station, value_type, date)),
nb AS (
  SELECT *,
    last_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER wb AS d0,
    last_value(value IGNORE NULLS) OVER wb AS y0,
    first_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER wf AS d1,
    first_value(value IGNORE NULLS) OVER wf AS y1
  FROM fullm
  WINDOW wb AS (PARTITION BY SITECODE, station, value_type ORDER BY date
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         wf AS (PARTITION BY SITECODE, station, value_type ORDER BY date
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
interp AS (
  SELECT SITECODE, station, value_type, date, value IS NULL AS missing,
         CASE WHEN value IS NULL
              THEN y0 + (y1 - y0) * date_diff('day', d0, date) / date_diff('day', d0, d1)
              ELSE value END AS value
  FROM nb)"""


@register("g1_daily_counts", BASE + f"SELECT SITECODE, station, DATE, {r6('count')} FROM daily")
def g1_daily_counts(spark, d):
    """Daily count per station; null when any value of the day is null."""
    return daily(spark, d)


@register("w1_interval", BASE + """SELECT SITECODE, station, DATE, "interval"::BIGINT AS "interval"
FROM drate""")
def w1_interval(spark, d):
    """Days since the previous record of the same station; first dropped."""
    return with_interval(daily(spark, d), ["station"], "DATE").drop("count")


@register("w2_daily_rate", BASE + f"SELECT SITECODE, DATE, station, {r6('value')}, value_type FROM drate")
def w2_daily_rate(spark, d):
    return st.daily_abundance_rate(clean(spark, d))


@register("g6_monthly_rate", BASE + f"SELECT SITECODE, station, date, {r6('value')}, value_type FROM mrate")
def g6_monthly_rate(spark, d):
    """Monthly abundance rate per station at month ends (the flagship)."""
    return st.monthly_abundance_rate(clean(spark, d))


@register("c3_complete_month_ends", BASE + ", cal AS (" + calendar_sql(
    "mrate", ["SITECODE", "station", "value_type"], "date", anchor="end") + """)
SELECT c.SITECODE, c.station, c.value_type, c.date, """ + r6("m.value", "value") + """
FROM cal c LEFT JOIN mrate m USING (SITECODE, station, value_type, date)""")
def c3_complete_month_ends(spark, d):
    m = st.monthly_abundance_rate(clean(spark, d))
    return complete_months(m, ["SITECODE", "station", "value_type"], "date", anchor="end")


@register("c5_interpolate", BASE + ", " + INTERP + f"""
SELECT SITECODE, station, value_type, date, missing, {r6('value')} FROM interp""")
def c5_interpolate(spark, d):
    return st.interpolated_monthly(st.monthly_abundance_rate(clean(spark, d)))


@register("d6_deseason_ma", BASE + ", " + INTERP + """,
ma AS (
  SELECT *, month(date) AS month,
    CASE WHEN count(value) OVER w13 = 13 THEN
      (lag(value, 6) OVER w + lead(value, 6) OVER w) / 24.0
      + (lag(value, 5) OVER w + lag(value, 4) OVER w + lag(value, 3) OVER w + lag(value, 2) OVER w
         + lag(value, 1) OVER w + value + lead(value, 1) OVER w + lead(value, 2) OVER w
         + lead(value, 3) OVER w + lead(value, 4) OVER w + lead(value, 5) OVER w) / 12.0 END AS ma
  FROM interp
  WINDOW w AS (PARTITION BY station ORDER BY date),
         w13 AS (PARTITION BY station ORDER BY date ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
ds AS (
  SELECT *, value - ma AS detrend_ma,
         avg(value - ma) OVER (PARTITION BY station, month) AS season_mean
  FROM ma)
SELECT SITECODE, station, value_type, date, missing, month, """ + ", ".join(
    [r6("value"), r6("ma"), r6("detrend_ma"), r6("season_mean"), r6("value - season_mean", "deseason")])
    + " FROM ds")
def d6_deseason_ma(spark, d):
    """Trend-aware deseason of the interpolated monthly rate."""
    return st.deseasoned_monthly(st.monthly_abundance_rate(clean(spark, d)))
