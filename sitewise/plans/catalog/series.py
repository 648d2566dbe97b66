"""Series-level queries: J3, J12, J13, D12-D14, K1-K4, K7, O2, O4."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions.dates import month_start
from sitewise.operators.changepoint import (attach_segment_mean, changepoint_fit, changepoints, joint_with_uni,
                                            segment_stats, shared_changepoints_per_series)
from sitewise.operators.smooth import moving_average
from sitewise.operators.spectrum import periodogram
from sitewise.operators.stack import stack_series
from sitewise.operators.counts import monthly_mean
from sitewise.operators.weather import weather_for_stations
from sitewise.plans import site, trap
from sitewise.plans import station as st
from sitewise.plans.catalog.common import clean, site_monthly
from sitewise.plans.catalog.season import MA, SMON, TRAP_STD, _comp_sql
from sitewise.plans.catalog.station import BASE, INTERP
from sitewise.plans.registry import r6, register
from sitewise.plans.sqlparts import (CLEAN, DAILY, DRATE, MRATE, NORMAL_MEANVAR_SQL, NORMAL_VAR_SQL, OBS,
                                     POISSON_SQL,
                                     WEATHER, calendar_sql, changepoint_sql, runs_sql, spread_sql,
                                     with_)
from sitewise.sources import standin

BM = with_(OBS, CLEAN, DAILY, DRATE, MRATE)
BD_RATE = with_(OBS, CLEAN, DAILY, DRATE)
BMR = BM.replace("WITH ", "WITH RECURSIVE ", 1)


@register("j3_weather_range", with_(OBS, CLEAN, WEATHER) + f""", rng AS (
  SELECT SITECODE, station, min(DATE) AS date_min, max(DATE) AS date_max FROM clean GROUP BY ALL)
SELECT w.DATE AS date, w.SITECODE, r.station, {r6('w.daily', 'value')}, w.FIELDNAME AS value_type
FROM weather w JOIN rng r ON w.SITECODE = r.SITECODE AND w.DATE BETWEEN r.date_min AND r.date_max""")
def j3_weather_range(spark, d):
    """Daily weather of each station's site within the station's dates."""
    return weather_for_stations(standin.weather(spark, d), clean(spark, d))


@register("d13_stack_series", BM + ", " + WEATHER + f"""
SELECT 'moth' AS kind, station AS id, date AS "index", {r6('value')} FROM mrate
UNION ALL
SELECT 'weather', SITECODE || '/' || FIELDNAME, date_trunc('month', DATE)::DATE, {r6('avg(daily)', 'value')}
FROM weather GROUP BY SITECODE, FIELDNAME, date_trunc('month', DATE)""")
def d13_stack_series(spark, d):
    """Monthly moth rate per station stacked with the monthly weather of each
    site, every field."""
    moth = st.monthly_abundance_rate(clean(spark, d))
    w = standin.weather(spark, d).withColumn("id", F.concat_ws("/", "SITECODE", "FIELDNAME"))
    wm = monthly_mean(w, ["id"], "DATE", "daily", na_rm=True, out="value", out_idx="DATE")
    return stack_series({"moth": (moth, "station", "date", "value"),
                         "weather": (wm, "id", "DATE", "value")})


@register("d12_periodogram", BASE + ", " + INTERP + f""",
ser AS (SELECT station, value - avg(value) OVER (PARTITION BY station) AS x,
               row_number() OVER (PARTITION BY station ORDER BY date) - 1 AS t,
               count(*) OVER (PARTITION BY station) AS n
        FROM interp WHERE value IS NOT NULL),
fr AS (SELECT DISTINCT station, n, unnest(range(1, n // 2 + 1)) AS j FROM ser)
SELECT fr.station, {r6('fr.j / fr.n', 'freq')},
  {r6('2.0 / fr.n * (pow(sum(x * cos(2 * pi() * fr.j * t / fr.n)), 2) + pow(sum(x * sin(2 * pi() * fr.j * t / fr.n)), 2))', 'spec')}
FROM fr JOIN ser USING (station) GROUP BY fr.station, fr.j, fr.n""")
def d12_periodogram(spark, d):
    """Periodogram of the interpolated monthly rate of each station."""
    return periodogram(st.interpolated_monthly(st.monthly_abundance_rate(clean(spark, d))),
                       ["station"], "date", "value")


_D14_CNT = """SELECT SITECODE, DATE, coalesce(sum(VALUE), 0) AS counts FROM clean GROUP BY ALL"""
_D14 = (with_(OBS, CLEAN, runs_sql("SITECODE")) + ",\n" + spread_sql("SITECODE", _D14_CNT, True) +
        """,
smon0 AS (SELECT SITECODE, date_trunc('month', DATE)::DATE AS DATETIME, coalesce(sum(counts), 0) AS counts
          FROM spread GROUP BY ALL),
scal AS (""" + calendar_sql("smon0", ["SITECODE"], "DATETIME") + """),
smon AS (SELECT c.SITECODE, c.DATETIME, coalesce(m.counts, 0) AS counts
         FROM scal c LEFT JOIN smon0 m USING (SITECODE, DATETIME))
""" + _comp_sql("avg", "decomp_seas_comp", "std_decomp_seas") + f""",
dec2 AS (SELECT *, {MA} AS ma2x12 FROM dec),
dec3 AS (SELECT *, counts - ma2x12 AS detrend_ma2x12, counts - std_decomp_seas AS decomp_deseason FROM dec2),
st AS (
  SELECT *, CASE WHEN count(decomp_deseason) OVER m = count(*) OVER m THEN stddev_samp(decomp_deseason) OVER m END AS decomp_deseason_sd,
         CASE WHEN count(decomp_deseason) OVER s = count(*) OVER s THEN avg(decomp_deseason) OVER s END AS site_mean
  FROM dec3 WINDOW m AS (PARTITION BY SITECODE, month), s AS (PARTITION BY SITECODE))
""")


@register("d14_multi_site", _D14 + "SELECT SITECODE, DATETIME, month, " + ", ".join(
    r6(c) for c in ["counts", "ma2x12", "detrend_ma2x12", "decomp_seas_comp", "std_decomp_seas",
                    "decomp_deseason", "decomp_deseason_sd"]) +
    ", " + r6("(decomp_deseason - site_mean) / decomp_deseason_sd", "decomp_deseason_std") + " FROM st")
def d14_multi_site(spark, d):
    """All sites in one plan: gaps shared, monthly, decomposed, standardised."""
    return site.multi_site(clean(spark, d), ["SITECODE"])


@register("d14_site_daily", with_(OBS, CLEAN, runs_sql("SITECODE")) + ",\n" + spread_sql("SITECODE", _D14_CNT, True) + f""",
sp AS (SELECT SITECODE, DATE, CASE WHEN coalesce(sum(VALUE), 0) = 0 THEN 0
         ELSE count(DISTINCT FIELDNAME) + max(CASE WHEN FIELDNAME IS NULL THEN 1 ELSE 0 END) END AS n_species FROM clean GROUP BY ALL)
SELECT s.SITECODE, s.DATE, {r6('s.counts', 'counts')}, s.duration, p.n_species FROM spread s LEFT JOIN sp p USING (SITECODE, DATE)""")
def d14_site_daily(spark, d):
    """Shared daily catch of each site with the number of species seen."""
    return site.site_daily(clean(spark, d), ["SITECODE"]).select("SITECODE", "DATE", "counts", "duration", "n_species")


# Changepoints.  Univariate: monthly rate per station, normal mean/var, bic.
_SER_UNI = BMR + ", ser AS (SELECT station AS g, station AS k, date AS d, value AS y FROM mrate WHERE value IS NOT NULL),\n"
_UNI = _SER_UNI + changepoint_sql("u", "ser", NORMAL_MEANVAR_SQL, "3 * ln(n)") + "\n"


def _mrate(spark, d):
    return st.monthly_abundance_rate(clean(spark, d))


@register("k5_normal_var_numeric_penalty", _SER_UNI + changepoint_sql("u", "ser", NORMAL_VAR_SQL, "10.0")
          + "\nSELECT g AS station, 'uni' AS cpt_type, loc FROM ulocs")
def k5_normal_var_numeric_penalty(spark, d):
    """Changes in variance around each station's overall mean, with a fixed
    penalty of 10 per changepoint."""
    return changepoints(_mrate(spark, d), ["station"], "date", "value", cost="normal_var", penalty=10.0)


@register("k1_changepoints", _UNI + "SELECT g AS station, 'uni' AS cpt_type, loc FROM ulocs")
def k1_changepoints(spark, d):
    """Changepoints in mean and variance of each station's monthly rate."""
    return changepoints(_mrate(spark, d), ["station"], "date", "value")


# Raw totals on a large level: the costs do not depend on it.
_SER_LEVEL = BMR + """, ser AS (SELECT station AS g, station AS k, last_day(DATE) AS d, sum(VALUE) + 1e6 AS y
  FROM clean WHERE VALUE IS NOT NULL GROUP BY ALL),
"""


@register("k1_large_level", _SER_LEVEL + changepoint_sql("u", "ser", NORMAL_MEANVAR_SQL, "1.5 * ln(n)")
          + "\nSELECT g AS station, 'uni' AS cpt_type, loc FROM ulocs")
def k1_large_level(spark, d):
    """Changepoints of each station's raw monthly totals plus a million."""
    total = clean(spark, d).filter(F.col("VALUE").isNotNull()).groupBy("station", F.last_day("DATE").alias("date")).agg(
        (F.sum("VALUE") + F.lit(1e6)).alias("y"))
    return changepoints(total, ["station"], "date", "y", penalty="log_n", penalty_factor=1.5)


# Per-site cost (K2): Poisson for odd nations, normal for even, bic.
_SITE_COST = {f"T{i:02d}": ("poisson_meanvar" if i % 2 else "normal_meanvar") for i in range(25)}
_K2_COST = f"CASE WHEN right(k, 1)::INT % 2 = 1 THEN {POISSON_SQL} ELSE {NORMAL_MEANVAR_SQL} END"
_K2_BETA = "CASE WHEN right(k, 1)::INT % 2 = 1 THEN 2 * ln(n) ELSE 3 * ln(n) END"
_K2 = (with_(OBS, CLEAN, SMON).replace("WITH ", "WITH RECURSIVE ", 1) + ", ser AS (SELECT SITECODE AS g, SITECODE AS k, DATETIME AS d, counts AS y FROM smon),\n"
       + changepoint_sql("s", "ser", _K2_COST, _K2_BETA) + "\n")


@register("k2_changepoints_per_site", _K2 + f"""SELECT g AS SITECODE, 'uni' AS cpt_type, loc FROM slocs""")
def k2_changepoints_per_site(spark, d):
    """Univariate changepoints of each site's monthly total, with a cost
    chosen per site."""
    return changepoints(site_monthly(spark, d), ["SITECODE"], "DATETIME", "counts",
                        cost=_SITE_COST, penalty="bic")


# Joint (K3): the stations of a site share changepoints; each station keeps
# its own months; penalty 0.5 ln n per station.
_SER_J = BMR + """, ser AS (SELECT SITECODE AS g, station AS k, date AS d, value AS y FROM mrate WHERE value IS NOT NULL),
useru AS (SELECT station AS g, station AS k, date AS d, value AS y FROM mrate WHERE value IS NOT NULL),
"""
_JOINT = _SER_J + changepoint_sql("j", "ser", NORMAL_MEANVAR_SQL, "0.5 * ln(n)") + "\n"
_JKW = dict(cost="normal_meanvar", penalty="log_n", penalty_factor=0.5)


@register("k3_joint_changepoints", _JOINT + "SELECT g AS SITECODE, 'joint' AS cpt_type, loc FROM jlocs")
def k3_joint_changepoints(spark, d):
    """Changepoints shared by the stations of each site."""
    return changepoints(_mrate(spark, d), ["SITECODE"], "date", "value", series="station", **_JKW)


@register("j12_joint_per_series", _JOINT + """SELECT l.g AS SITECODE, k.k AS station, 'joint' AS cpt_type, l.loc
FROM jlocs l JOIN jkeys k ON k.g = l.g""")
def j12_joint_per_series(spark, d):
    """The shared changepoints of a site repeated for each of its stations."""
    return shared_changepoints_per_series(_mrate(spark, d), ["SITECODE"], "station", "date", "value", **_JKW)


@register("k4_joint_with_uni", _SER_J + changepoint_sql("j", "ser", NORMAL_MEANVAR_SQL, "0.5 * ln(n)") + ",\n"
          + changepoint_sql("v", "useru", NORMAL_MEANVAR_SQL, "0.5 * ln(n)") + f"""
SELECT f.g AS SITECODE, NULL::VARCHAR AS station, 'joint' AS cpt_type, {r6('f.cost', 'cost')},
       (SELECT count(*) FROM jlocs l WHERE l.g = f.g) AS n_cpts, f.t AS n_grid FROM jfin f
UNION ALL
SELECT split_part(f.g, '-', 1), f.g, 'uni', {r6('f.cost', 'cost')},
       (SELECT count(*) FROM vlocs l WHERE l.g = f.g), f.t FROM vfin f""")
def k4_joint_with_uni(spark, d):
    """Joint fit of each site and univariate fit of each station, with
    their optimal costs and numbers of changepoints."""
    m = _mrate(spark, d)
    return joint_with_uni(m, ["SITECODE"], "station", "date", "value", **_JKW).drop("locs")


@register("k7_segment_stats", _UNI + f""", seg AS (
  SELECT s.g AS station, s.d AS date, s.y,
         (SELECT count(*) FROM ulocs l WHERE l.g = s.g AND l.loc < s.d) AS segment FROM ser s)
SELECT station, segment, min(date) AS start, max(date) AS "end", count(y) AS n, {r6('avg(y)', 'mean')},
  {r6('stddev_samp(y)', 'sd')},
  {r6('count(y) * (ln(2 * pi()) + ln(greatest(var_pop(y), 1e-8)) + 1)', 'cost')}
FROM seg GROUP BY station, segment""")
def k7_segment_stats(spark, d):
    """Per segment of each station: dates, n, mean, sd and cost."""
    return segment_stats(_mrate(spark, d), None, ["station"], "date", "value")


@register("j13_segment_means", _UNI + f""", seg AS (
  SELECT s.SITECODE, s.station, s.date, s.value,
         (SELECT count(*) FROM ulocs l WHERE l.g = s.station AND l.loc < s.date) AS segment FROM mrate s)
SELECT SITECODE, station, date, {r6('value')}, segment, {r6('avg(value) OVER (PARTITION BY station, segment)', 'cpts')}
FROM seg""")
def j13_segment_means(spark, d):
    """Each monthly rate, null ones too, with the mean of its changepoint
    segment."""
    m = _mrate(spark, d).select("SITECODE", "station", "date", "value")
    return attach_segment_mean(m, None, ["station"], "date", "value").drop("cpt_type")


_SMOOTH = (with_(OBS, CLEAN, SMON).replace("WITH ", "WITH RECURSIVE ", 1) + f""", sm AS (SELECT *, {MA} AS ma2x12 FROM smon),
ser AS (SELECT SITECODE AS g, SITECODE AS k, DATETIME AS d, ma2x12 AS y FROM sm WHERE ma2x12 IS NOT NULL),
""" + changepoint_sql("m", "ser", NORMAL_MEANVAR_SQL, "3 * ln(n)"))


@register("j13_smoothed_means", _SMOOTH + f""", seg AS (SELECT sm.*,
  (SELECT count(*) FROM mlocs l WHERE l.g = sm.SITECODE AND l.loc < sm.DATETIME) AS segment FROM sm)
SELECT SITECODE, DATETIME, {r6('counts')}, {r6('ma2x12')}, segment,
       {r6('avg(ma2x12) OVER (PARTITION BY SITECODE, segment)', 'cpts')} FROM seg""")
def j13_smoothed_means(spark, d):
    """Segment means of the 2x12 moving average beside every month of the
    site, the ends without an average too."""
    m = moving_average(site_monthly(spark, d), ["SITECODE"], "DATETIME", "counts", "2x12")
    return attach_segment_mean(m, None, ["SITECODE"], "DATETIME", "ma2x12").drop("cpt_type")


# More than 400 dates: means of five days over all sites.
_BIN5 = "DATE '1990-01-01' + (date_diff('day', DATE '1990-01-01', DATE) // 5 * 5)::INT"
_FIVE = (with_(OBS, CLEAN).replace("WITH ", "WITH RECURSIVE ", 1) + f""", ser AS (SELECT 'all' AS g, 'all' AS k, {_BIN5} AS d,
  avg(VALUE) AS y FROM clean GROUP BY ALL HAVING avg(VALUE) IS NOT NULL),
""" + changepoint_sql("f", "ser", NORMAL_MEANVAR_SQL, "0.75 * ln(n)"))


def _binned(df, days: int, keys=("SITECODE",)):
    """Mean value per key and bin of days, dated the first of the bin."""
    start = F.lit("1990-01-01").cast("date")
    at = F.date_add(start, (F.floor(F.datediff("DATE", start) / days) * days).cast("int"))
    return df.groupBy(*keys, at.alias("d")).agg(F.avg("VALUE").alias("y"))


@register("k1_five_day_means", _FIVE + "\nSELECT g AS \"all\", 'uni' AS cpt_type, loc FROM flocs")
def k1_five_day_means(spark, d):
    """Changepoints of the five-day means of all sites: about 500 dates."""
    five = _binned(clean(spark, d).withColumn("all", F.lit("all")), 5, ["all"])
    return changepoints(five, ["all"], "d", "y", penalty="log_n", penalty_factor=0.75)


# All sites as one group (the site pipeline's deseasoned series).
_ALL = _D14.replace("WITH ", "WITH RECURSIVE ", 1) + """, ser AS (SELECT 'all' AS g, SITECODE AS k, DATETIME AS d,
  decomp_deseason AS y FROM st WHERE decomp_deseason IS NOT NULL),
"""


def _all_sites(spark, d):
    return site.multi_site(clean(spark, d), ["SITECODE"]).withColumn("all", F.lit("all"))


@register("k3_sites_joint", _ALL + changepoint_sql("a", "ser", NORMAL_MEANVAR_SQL, "3 * ln(n)")
          + f"\nSELECT g AS \"all\", {r6('cost')}, (SELECT count(*) FROM alocs) AS n_cpts, t AS n_grid FROM afin")
def k3_sites_joint(spark, d):
    """One joint fit of all sites on the deseasoned series, bic."""
    return changepoint_fit(_all_sites(spark, d), ["all"], "DATETIME", "decomp_deseason", series="SITECODE").select(
        "all", "cost", "n_cpts", "n_grid")


@register("k3_sites_joint_low", _ALL + changepoint_sql("a", "ser", NORMAL_MEANVAR_SQL, "0.4 * ln(n)")
          + "\nSELECT g AS \"all\", 'joint' AS cpt_type, loc FROM alocs")
def k3_sites_joint_low(spark, d):
    """The same with a penalty low enough to find shared points."""
    return changepoints(_all_sites(spark, d), ["all"], "DATETIME", "decomp_deseason", series="SITECODE",
                        penalty="log_n", penalty_factor=0.4)


# Series of different rate on one grid: per site annual totals and fortnightly
# means; monthly totals and fortnightly means.
_BIN14 = _BIN5.replace("5", "14")
_FORT = f"SELECT SITECODE AS g, 'fortnightly' AS k, {_BIN14} AS d, avg(VALUE) AS y FROM clean GROUP BY ALL HAVING avg(VALUE) IS NOT NULL"


def _two_rates(spark, d, coarse, name):
    c = clean(spark, d)
    total = c.groupBy("SITECODE", coarse.alias("d")).agg(F.sum("VALUE").alias("y")).withColumn("rate", F.lit(name))
    return total.unionByName(_binned(c, 14).withColumn("rate", F.lit("fortnightly")))


@register("k3_annual_fortnightly", with_(OBS, CLEAN).replace("WITH ", "WITH RECURSIVE ", 1) + f""", ser AS (
  SELECT SITECODE AS g, 'annual' AS k, make_date(year(DATE), 12, 31) AS d, sum(VALUE) AS y FROM clean GROUP BY ALL HAVING sum(VALUE) IS NOT NULL
  UNION ALL {_FORT}),
""" + changepoint_sql("x", "ser", NORMAL_VAR_SQL, "0.5 * ln(n)") + "\nSELECT g AS SITECODE, 'joint' AS cpt_type, loc FROM xlocs")
def k3_annual_fortnightly(spark, d):
    """Changepoints shared by a site's annual totals and fortnightly means,
    in variance."""
    both = _two_rates(spark, d, F.make_date(F.year("DATE"), F.lit(12), F.lit(31)), "annual")
    return changepoints(both, ["SITECODE"], "d", "y", series="rate", cost="normal_var", penalty="log_n", penalty_factor=0.5)


@register("k3_monthly_fortnightly", with_(OBS, CLEAN).replace("WITH ", "WITH RECURSIVE ", 1) + f""", ser AS (
  SELECT SITECODE AS g, 'monthly' AS k, date_trunc('month', DATE)::DATE AS d, sum(VALUE) AS y FROM clean GROUP BY ALL HAVING sum(VALUE) IS NOT NULL
  UNION ALL {_FORT}),
""" + changepoint_sql("x", "ser", f"CASE WHEN k = 'monthly' THEN {POISSON_SQL} ELSE {NORMAL_MEANVAR_SQL} END",
                      "CASE WHEN k = 'monthly' THEN 2 * ln(n) ELSE 3 * ln(n) END")
          + "\nSELECT g AS SITECODE, 'joint' AS cpt_type, loc FROM xlocs")
def k3_monthly_fortnightly(spark, d):
    """Changepoints shared by a site's monthly totals (Poisson) and
    fortnightly means (normal), bic of each."""
    both = _two_rates(spark, d, month_start("DATE"), "monthly")
    return changepoints(both, ["SITECODE"], "d", "y", series="rate", penalty="bic",
                        cost={"monthly": "poisson_meanvar", "fortnightly": "normal_meanvar"})


@register("o2_last_rows", BM + f"SELECT station, date, {r6('value')} FROM mrate ORDER BY date DESC, station LIMIT 10")
def o2_last_rows(spark, d):
    """The last 10 monthly rates (a head/tail report: the limit is the feature)."""
    return (_mrate(spark, d).select("station", "date", "value")
            .orderBy(F.desc("date"), F.asc("station")).limit(10))


@register("o4_random_rows", BD_RATE + f"""SELECT SITECODE, DATE, station, {r6('value')}, value_type FROM drate
ORDER BY md5(concat_ws('|', '42', station, DATE::VARCHAR)), station, DATE LIMIT 10""")
def o4_random_rows(spark, d):
    """A random sample of 10 daily rates (a sampling operator): the first by
    a digest of key and seed, so a seed always gives the same sample."""
    r = st.daily_abundance_rate(clean(spark, d))
    return r.orderBy(F.md5(F.concat_ws("|", F.lit("42"), "station", F.col("DATE").cast("string"))), "station", "DATE").limit(10)


_SER_K8 = BMR + """, europe AS (SELECT 'T' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS SITECODE FROM nation
                 JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'),
ser AS (SELECT SITECODE AS g, station AS k, date AS d, value AS y FROM mrate
        WHERE value IS NOT NULL AND SITECODE IN (SELECT SITECODE FROM europe)),
"""


@register("k8_selected_series", _SER_K8 + changepoint_sql("j", "ser", NORMAL_MEANVAR_SQL, "0.5 * ln(n)")
          + "\nSELECT g AS SITECODE, 'joint' AS cpt_type, loc FROM jlocs")
def k8_selected_series(spark, d):
    """Shared changepoints of the series chosen for the fit: the stations of
    the sites of one region (selection by semi join before the fit)."""
    from sitewise.operators.filters import filter_in
    m = filter_in(_mrate(spark, d), "SITECODE", standin.region_sites(spark, d, "EUROPE"))
    return changepoints(m, ["SITECODE"], "date", "value", series="station", **_JKW)


def _trap_weather(spark, d, weather):
    stacked = trap.with_site_weather(trap.trap_standardised(clean(spark, d), max_interval=5), weather)
    return stacked.withColumn("site", trap.site_of_series())


@register("k3_trap_weather_joint")
def k3_trap_weather_joint(spark, d):
    """Shared changepoints of each site's monthly standardised trap series and
    its daily weather, every field (series of different sampling rate on one
    grid), penalty 0.5 ln n per series as in the other joint queries.  No SQL:
    the costs of all segments of a daily grid, for every series of a site,
    are some 10^9 rows; ``k3_trap_weather_fortnightly`` is the same fit on
    fortnightly means of the weather, with SQL."""
    return changepoints(_trap_weather(spark, d, standin.weather(spark, d)), ["site"], "index", "value", series="id", **_JKW)


@register("k3_trap_weather_fortnightly", TRAP_STD.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + WEATHER + f""", ser AS (
  SELECT split_part(TRAPCODE, '-', 1) AS g, TRAPCODE AS k, DATE AS d, deseason / ssd AS y FROM t4 WHERE deseason / ssd IS NOT NULL
  UNION ALL SELECT SITECODE, SITECODE || '/' || FIELDNAME, {_BIN14}, avg(daily) FROM weather GROUP BY ALL HAVING avg(daily) IS NOT NULL),
""" + changepoint_sql("w", "ser", NORMAL_MEANVAR_SQL, "0.5 * ln(n)") + "\nSELECT g AS site, 'joint' AS cpt_type, loc FROM wlocs")
def k3_trap_weather_fortnightly(spark, d):
    """The same with fortnightly means of each weather field."""
    start = F.lit("1990-01-01").cast("date")
    at = F.date_add(start, (F.floor(F.datediff("DATE", start) / 14) * 14).cast("int"))
    w = standin.weather(spark, d).groupBy("SITECODE", "FIELDNAME", at.alias("DATE")).agg(F.avg("daily").alias("daily"))
    return changepoints(_trap_weather(spark, d, w), ["site"], "index", "value", series="id", **_JKW)
