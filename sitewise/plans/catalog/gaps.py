"""Calendar and gap queries: C1, C2, C4, C6-C10, J6, J10, J11, G4, G17."""

from __future__ import annotations

from sitewise.operators.calendar import (all_dates_present, complete_days, complete_months,
                                         fill_month_median, missing_months)
from sitewise.operators.counts import monthly_totals, zero_day_summary
from sitewise.operators.filters import Taxa
from sitewise.operators.gaps import missing_days, missing_runs, top_missing_runs
from sitewise.plans.catalog.common import clean, daily, monthly_by_group
from sitewise.plans.site import site_daily
from sitewise.plans.registry import r6, register
from sitewise.plans.sqlparts import (CLEAN, DAILY, GROUPS, OBS, calendar_sql, runs_sql,
                                     spread_sql, with_)
from sitewise.sources import standin

GKEYS = ["station", "IM_GROUP"]
# Catches are shared over gaps of at most 3 days; the taxon
# of the gap queries is one functional group of the stand-in.
MAX_GAP = 3
TAXON = "MEDIUM"

MGRP = """mgrp AS (
  SELECT station, IM_GROUP, date_trunc('month', DATE)::DATE AS DATETIME, sum(VALUE) AS counts
  FROM clean JOIN grp ON FIELDNAME = IM_SPEC WHERE VALUE IS NOT NULL GROUP BY ALL)"""
BG = with_(OBS, CLEAN, GROUPS, MGRP) + ", mcal AS (" + calendar_sql("mgrp", GKEYS, "DATETIME") + ")\n"


@register("c2_complete_months", BG + f"""SELECT c.station, c.IM_GROUP, c.DATETIME,
  {r6('coalesce(m.counts, 0)', 'counts')}
FROM mcal c LEFT JOIN mgrp m USING (station, IM_GROUP, DATETIME)""")
def c2_complete_months(spark, d):
    """Every month of each station x group series; a missing count is 0."""
    return complete_months(monthly_by_group(spark, d), GKEYS, "DATETIME", fill={"counts": 0})


@register("j10_all_months_present", BG + """, miss AS (
  SELECT station, IM_GROUP, count(*) AS n_missing FROM mcal c
  WHERE NOT EXISTS (SELECT 1 FROM mgrp m WHERE m.station = c.station AND m.IM_GROUP = c.IM_GROUP
                    AND m.DATETIME = c.DATETIME) GROUP BY ALL)
SELECT b.station, b.IM_GROUP, b.n_months, coalesce(miss.n_missing, 0)::BIGINT AS n_missing,
       coalesce(miss.n_missing, 0) = 0 AS all_present
FROM (SELECT station, IM_GROUP, count(*) AS n_months FROM mcal GROUP BY ALL) b
LEFT JOIN miss USING (station, IM_GROUP)""")
def j10_all_months_present(spark, d):
    """Whether every calendar month is present, per series."""
    return all_dates_present(monthly_by_group(spark, d), GKEYS, "DATETIME")


@register("j11_missing_months", BG + """SELECT c.station, c.IM_GROUP, c.DATETIME FROM mcal c
ANTI JOIN mgrp m USING (station, IM_GROUP, DATETIME)""")
def j11_missing_months(spark, d):
    return missing_months(monthly_by_group(spark, d), GKEYS, "DATETIME")


@register("c4_fill_month_median", BG + f"""SELECT station, IM_GROUP, DATETIME, month, missing,
  {r6('coalesce(counts, median(counts) OVER (PARTITION BY station, IM_GROUP, month))', 'counts')}
FROM (SELECT c.station, c.IM_GROUP, c.DATETIME, m.counts, month(c.DATETIME) AS month,
             m.counts IS NULL AS missing
      FROM mcal c LEFT JOIN mgrp m USING (station, IM_GROUP, DATETIME))""")
def c4_fill_month_median(spark, d):
    """Missing months take the median of the same calendar month."""
    return fill_month_median(monthly_by_group(spark, d), GKEYS, "DATETIME", "counts")


@register("c1_complete_days", with_(OBS, CLEAN, DAILY) + ", dcal AS (" +
          calendar_sql("daily", ["SITECODE", "station"], "DATE", unit="day") + f""")
SELECT c.SITECODE, c.station, c.DATE, {r6('d.count', 'count')}
FROM dcal c LEFT JOIN daily d USING (SITECODE, station, DATE)""")
def c1_complete_days(spark, d):
    """Every day between a station's first and last record."""
    return complete_days(daily(spark, d), ["SITECODE", "station"], "DATE")


RUNS = runs_sql("station")
BR = with_(OBS, CLEAN, RUNS) + "\n"


def _runs(spark, d, days: bool = True):
    stretches = missing_days(clean(spark, d), ["station"], "DATE", "VALUE", spans=True, deal=True)
    return missing_runs(stretches, ["station"], "DATE", spans=True, days=days)


@register("c6_missing_days", BR + "SELECT station, DATE FROM miss")
def c6_missing_days(spark, d):
    """Days without a record, or with a null value, per station."""
    return missing_days(clean(spark, d), ["station"], "DATE", "VALUE", deal=True)


@register("c7_missing_runs", BR + "SELECT * FROM runs")
def c7_missing_runs(spark, d):
    return _runs(spark, d)


@register("c8_top_missing_runs", BR + """SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY station ORDER BY duration DESC, seq_id) AS rank
  FROM (SELECT DISTINCT station, seq_id, STARTDATE, ENDDATE, duration FROM runs))
WHERE rank <= 10""")
def c8_top_missing_runs(spark, d):
    """The 10 longest unsampled periods of each station."""
    return top_missing_runs(_runs(spark, d, days=False), ["station"], 10, days=False)


def _spread_sql(zero_fill: bool) -> str:
    cnt = f"""SELECT station, DATE, coalesce(sum(VALUE), 0) AS counts
        FROM clean JOIN grp ON FIELDNAME = IM_SPEC WHERE IM_GROUP = '{TAXON}' GROUP BY ALL"""
    return with_(OBS, CLEAN, GROUPS, RUNS) + ",\n" + spread_sql("station", cnt, zero_fill, MAX_GAP) + "\n"


def _spread(spark, d, zero_fill: bool):
    """The site pipeline's daily grid, keyed by station, for one group."""
    out = site_daily(clean(spark, d), ["station"], taxa=Taxa(group=TAXON),
                     groups=standin.groups(spark, d), max_gap=MAX_GAP, zero_fill=zero_fill, deal=True)
    return out.select("station", "DATE", "counts", "duration")


@register("c9_spread_over_gaps", _spread_sql(False) + f"SELECT station, DATE, duration, {r6('counts')} FROM spread")
def c9_spread_over_gaps(spark, d):
    """Catch of one group shared over gaps of up to 3 days; sampled days
    without the group take the next count (the field scripts' rule)."""
    return _spread(spark, d, zero_fill=False)


@register("c10_spread_zero_fill", _spread_sql(True) + f"SELECT station, DATE, duration, {r6('counts')} FROM spread")
def c10_spread_zero_fill(spark, d):
    """Same, with sampled days without the group counted as 0."""
    return _spread(spark, d, zero_fill=True)


def _spread_all_sql() -> str:
    cnt = "SELECT station, DATE, coalesce(sum(VALUE), 0) AS counts FROM clean GROUP BY ALL"
    return with_(OBS, CLEAN, RUNS) + ",\n" + spread_sql("station", cnt, True, MAX_GAP) + "\n"


def _spread_all(spark, d):
    """The daily grid of all taxa together."""
    return site_daily(clean(spark, d), ["station"], max_gap=MAX_GAP, deal=True)


@register("g4_monthly_totals", _spread_all_sql() + f"""SELECT station, date_trunc('month', DATE)::DATE AS DATETIME,
  {r6('coalesce(sum(counts), 0)', 'counts')}, count(*) FILTER (WHERE counts IS NULL) AS NA_per_mo
FROM spread GROUP BY station, date_trunc('month', DATE)""")
def g4_monthly_totals(spark, d):
    """Monthly totals of the shared daily counts, with null days counted."""
    return monthly_totals(_spread_all(spark, d), ["station"], "DATE", "counts")


@register("g17_zero_days", _spread_all_sql() + """SELECT station, count(*) AS n_days,
  count(*) FILTER (WHERE counts = 0) AS n_zero, count(*) FILTER (WHERE counts != 0) AS n_nonzero,
  count(*) FILTER (WHERE counts IS NULL) AS n_null FROM spread GROUP BY station""")
def g17_zero_days(spark, d):
    return zero_day_summary(_spread_all(spark, d), ["station"], "counts")
