"""Ingest and cleaning queries: S1, S4-S6, P1-P10, P13, P14, J1, J2."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from sitewise.functions.dates import (month_end, month_start, parse_2digit_date,
                                      with_calendar_parts, year_end)
from sitewise.functions.flags import drop_flag_rows, with_flag_id
from sitewise.functions.keys import site_of, with_station
from sitewise.operators.counts import daily_counts
from sitewise.operators.enrich import enrich
from sitewise.operators.filters import Taxa, between_dates, filter_in, select_taxa
from sitewise.plans import station
from sitewise.plans.catalog.common import clean, obs
from sitewise.plans.registry import r6, register
from sitewise.plans.sqlparts import (CLEAN, DAILY, DRATE, GROUPS, MRATE, OBS, TRAITS, WEATHER, parse_date_sql,
                                     with_)
from sitewise.sources import standin
from sitewise.sources.readers import (PROBLEM, clean_observations, read_annual_series, read_dimension, read_fortnightly_series,
                                      read_observations, read_ordered, read_traits, read_weather, rejected_observations,
                                      trim_trait_code, write_ordered, write_report)
from sitewise.sources.store import store_series

B = with_(OBS)
BC = with_(OBS, CLEAN)
BJ = with_(OBS, CLEAN, GROUPS, TRAITS) + """, enr AS (
  SELECT c.*, g.IM_GROUP, g.DESC_COMMON, t.Genus, t.WINGSPAN
  FROM clean c LEFT JOIN grp g ON c.FIELDNAME = g.IM_SPEC
               LEFT JOIN traits t ON c.FIELDNAME = t.IM_CODE)
"""


@register("s1_observations", B + f"SELECT SITECODE, LCODE, SDATE, FIELDNAME, {r6('VALUE')} FROM obs")
def s1_observations(spark, d):
    """Long observation rows with the fixed schema of the field files."""
    return obs(spark, d)


@register("s4_weather", with_(WEATHER) + f"SELECT SITECODE, DATE, FIELDNAME, {r6('daily')} FROM weather")
def s4_weather(spark, d):
    return standin.weather(spark, d)


@register("s5_trim_traits", with_(TRAITS) + f"SELECT IM_CODE, Genus, species, COMMON_NAME, Family, "
          f"{r6('WINGSPAN')} FROM traits")
def s5_trim_traits(spark, d):
    """Trait codes lose their 3-character prefix so they match field names."""
    return trim_trait_code(standin.raw_traits(spark, d))


@register("s6_annual_series", BC + f"""SELECT station, make_date(year(DATE), 12, 31) AS DATETIME,
  {r6('sum(VALUE)', 'ANNUAL_TOTAL')}
FROM clean GROUP BY station, year(DATE)
HAVING make_date(year(DATE), 12, 31) BETWEEN DATE '1996-12-31' AND DATE '2000-02-21'""")
def s6_annual_series(spark, d):
    """Annual series per station dated 31 December (P3), in a date window."""
    a = (clean(spark, d).groupBy("station", year_end(F.year("DATE")).alias("DATETIME"))
         .agg(F.sum("VALUE").alias("ANNUAL_TOTAL")))
    return between_dates(a, "DATETIME", "1996-12-31", "2000-02-21")


def _place(spark, d, query: str) -> str:
    """Where a query keeps the file it reads back: one folder for each query
    and data folder in the session's shared folder (the checkpoint folder,
    else the warehouse), written over by the next run."""
    base = (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
            or spark.conf.get("spark.sql.warehouse.dir"))
    return f"{base.rstrip('/')}/sitewise-{query}-{hashlib.md5(d.encode()).hexdigest()[:12]}"


def _written(spark, d, df, query: str, fmt: str = "csv") -> str:
    """Write a stand-in and return its path: the readers are then used on
    files as they are on field data."""
    path = _place(spark, d, query)
    write_report(df, path, fmt)
    return path


@register("s1_read_observations", BC + f"SELECT SITECODE, station, DATE, FIELDNAME, {r6('VALUE')} FROM clean")
def s1_read_observations(spark, d):
    """Observations written as a file, read and cleaned by the reader."""
    path = _written(spark, d, obs(spark, d), "s1")
    return clean_observations(read_observations(spark, path)).select("SITECODE", "station", "DATE", "FIELDNAME", "VALUE")


# Rows spoilt on purpose, by the value they hold: no site, a date that is
# none, text behind the trap number, text behind the value.
_SPOILT = B + """, spoilt AS (
  SELECT CASE WHEN VALUE = 47 THEN NULL ELSE SITECODE END AS site, LCODE, VALUE,
         CASE WHEN VALUE = 47 THEN 'no site' WHEN VALUE = 49 THEN 'no trap' WHEN VALUE = 48 THEN 'bad date' ELSE 'malformed' END AS reason,
         CASE WHEN VALUE = 49 THEN 'LCODE: ' || LCODE || '?' WHEN VALUE = 50 THEN 'VALUE: 50x' END AS problem
  FROM obs WHERE VALUE BETWEEN 47 AND 50)
"""


def _spoilt(spark, d):
    o, v = obs(spark, d), F.col("VALUE")
    return o.select(F.when(v == 47, None).otherwise(F.col("SITECODE")).alias("SITECODE"),
                    F.when(v == 49, F.concat(F.col("LCODE").cast("string"), F.lit("?"))).otherwise(F.col("LCODE").cast("string")).alias("LCODE"),
                    F.when(v == 48, F.lit("32-Foo-95")).otherwise(F.col("SDATE")).alias("SDATE"), "FIELDNAME",
                    F.when(v == 50, F.lit("50x")).otherwise(v.cast("string")).alias("VALUE"))


@register("s1_rejected_observations", _SPOILT + "SELECT site AS SITECODE, reason, problem, count(*) AS n FROM spoilt GROUP BY ALL")
def s1_rejected_observations(spark, d):
    """A file with bad numbers, dates and keys: every such row comes back with
    the reason and what the field holds, counted here by site."""
    path = _written(spark, d, _spoilt(spark, d), "s1-rejected")
    bad = rejected_observations(read_observations(spark, path, problems=True))
    return bad.groupBy("SITECODE", "reason", F.col(PROBLEM).alias("problem")).agg(F.count("*").alias("n"))


@register("s2_read_dataset", BC + "SELECT SITECODE, count(*) AS n FROM clean GROUP BY SITECODE")
def s2_read_dataset(spark, d):
    """The same with the file chosen by dataset name."""
    path = _written(spark, d, obs(spark, d), "s2")
    root, name = path.rsplit("/", 1)
    df = read_observations(spark, dataset="own", root=root, datasets={"own": name})
    return clean_observations(df).groupBy("SITECODE").agg(F.count("*").alias("n"))


@register("s3_read_dimension", with_(GROUPS) + "SELECT IM_SPEC, IM_GROUP, DESC_COMMON, DESC_LATIN FROM grp")
def s3_read_dimension(spark, d):
    """The groups through a text file with an explicit schema (S3)."""
    return read_dimension(spark, _written(spark, d, standin.groups(spark, d), "s3"))


@register("s4_read_weather", with_(WEATHER) + f"SELECT SITECODE, DATE, FIELDNAME, {r6('daily')} FROM weather")
def s4_read_weather(spark, d):
    """Weather through a Parquet file."""
    return read_weather(spark, _written(spark, d, standin.weather(spark, d), "s4", "parquet"))


@register("s5_read_traits", with_(TRAITS) + f"SELECT IM_CODE, Genus, species, COMMON_NAME, Family, {r6('WINGSPAN')} FROM traits")
def s5_read_traits(spark, d):
    """The traits through a text file, the prefix of the code cut."""
    return read_traits(spark, _written(spark, d, standin.raw_traits(spark, d), "s5"))


@register("s6_read_annual", BC + f"""SELECT make_date(year(DATE), 12, 31) AS DATETIME, {r6('sum(VALUE)', 'ANNUAL_AVG_ABUNDANCE')}
FROM clean WHERE SITECODE = 'T03' GROUP BY year(DATE)
HAVING make_date(year(DATE), 12, 31) BETWEEN DATE '1996-12-31' AND DATE '2000-02-21'""")
def s6_read_annual(spark, d):
    """Annual totals of all sites written, one site and a window read."""
    a = (clean(spark, d).groupBy(F.year("DATE").alias("YEAR"), F.col("SITECODE").alias("SITE")).agg(F.sum("VALUE").alias("ANNUAL_AVG_ABUNDANCE"))
         .select("YEAR", "SITE", F.lit("count").alias("DETERMINAND"), "ANNUAL_AVG_ABUNDANCE"))
    return read_annual_series(spark, _written(spark, d, a, "s6-annual"), site="T03", determinand="count", start="1996-12-31", end="2000-02-21")


@register("s6_read_fortnightly", BC + f"""SELECT DATE AS DATETIME, {r6('avg(VALUE)', 'VALUE')} FROM clean
WHERE SITECODE = 'T05' GROUP BY DATE HAVING avg(VALUE) IS NOT NULL AND DATE BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""")
def s6_read_fortnightly(spark, d):
    """A series with two-digit years written, read with pivot 21."""
    f = (clean(spark, d).groupBy("SITECODE", "DATE").agg(F.avg("VALUE").alias("VALUE")).where("VALUE is not null")
         .select(F.date_format("DATE", "dd-MMM-yy").alias("DATE"), F.col("SITECODE").alias("VARIABLE"),
                 F.lit("").alias("sign_if_LT_LOD"), "VALUE"))
    return read_fortnightly_series(spark, _written(spark, d, f, "s6-fortnightly"), variable="T05", start="1996-01-01", end="1998-12-31")


@register("s7_stored_monthly_rate", with_(OBS, CLEAN, DAILY, DRATE, MRATE) + f"SELECT SITECODE, station, date, {r6('value')}, value_type FROM mrate")
def s7_stored_monthly_rate(spark, d):
    """The station pipeline over a table bucketed by station: no exchange
    after the table is written (S7)."""
    at = _place(spark, d, "s7")
    rows = clean(spark, d).select("SITECODE", "station", "DATE", "VALUE")
    kept = store_series(rows, at.rsplit("/", 1)[1].replace("-", "_"), ["station"], "DATE", 16, at)
    return station.monthly_abundance_rate(kept)


@register("o1_ordered_report", with_(OBS, CLEAN, DAILY, DRATE, MRATE) + f"""SELECT station, date, {r6('value')},
  row_number() OVER (ORDER BY station, date) AS line FROM mrate""")
def o1_ordered_report(spark, d):
    """Monthly rates written in order of station and date, and read back with
    the line each row has in the report (O1)."""
    at = _place(spark, d, "o1")
    write_ordered(station.monthly_abundance_rate(clean(spark, d)).select("station", "date", "value"), at, ["station", "date"])
    return read_ordered(spark, at, "station string, date date, value double")


# Fixed table of periods, made in the query.
_PERIODS = [("early", "1992-01-01", "1994-06-30"), ("middle", "1994-07-01", "1996-12-31"), ("late", "1997-01-01", "2005-12-31")]


@register("s8_literal_periods", BC + f""", periods(period, lo, hi) AS (VALUES {", ".join(f"('{p}', DATE '{a}', DATE '{b}')" for p, a, b in _PERIODS)})
SELECT SITECODE, period, count(*) AS n, {r6('sum(VALUE)', 'total')} FROM clean JOIN periods ON DATE BETWEEN lo AND hi GROUP BY ALL""")
def s8_literal_periods(spark, d):
    """Totals of each site in three periods given as a literal table, laid out
    as a calendar of months so that the join is on equal keys (S8)."""
    p = spark.createDataFrame(_PERIODS, "period string, lo string, hi string")
    months = p.select("period", F.explode(F.sequence(F.col("lo").cast("date"), F.col("hi").cast("date"), F.expr("interval 1 month"))).alias("month"))
    c = clean(spark, d).withColumn("month", month_start("DATE"))
    return c.join(F.broadcast(months), "month").groupBy("SITECODE", "period").agg(F.count("*").alias("n"), F.sum("VALUE").alias("total"))


@register("p1_parse_2digit_date", B + f"SELECT SITECODE, LCODE, SDATE, {parse_date_sql('SDATE', 69)} AS DATE FROM obs")
def p1_parse_2digit_date(spark, d):
    return obs(spark, d).select("SITECODE", "LCODE", "SDATE",
                                parse_2digit_date("SDATE", 69).alias("DATE"))


# The stand-in has the years 95 to 01 only; for the pivot the last two digits
# are replaced by years on either side of both pivots, by trap code.
_YEARS = ["20", "21", "68", "69"]


@register("p2_parse_pivot21", B + f""", shifted AS (SELECT SITECODE, LCODE,
  left(SDATE, length(SDATE) - 2) || CASE LCODE % 4 WHEN 0 THEN '20' WHEN 1 THEN '21' WHEN 2 THEN '68' ELSE '69' END AS SDATE FROM obs)
SELECT SITECODE, LCODE, SDATE, {parse_date_sql('SDATE', 21)} AS DATE, {parse_date_sql('SDATE', 69)} AS DATE_69 FROM shifted""")
def p2_parse_pivot21(spark, d):
    """Century pivot 21 beside 69 on years where they differ."""
    year = F.element_at(F.array(*[F.lit(y) for y in _YEARS]), (F.col("LCODE") % 4 + 1).cast("int"))
    text = F.concat(F.expr("substr(SDATE, 1, length(SDATE) - 2)"), year)
    o = obs(spark, d).withColumn("SDATE", text)
    return o.select("SITECODE", "LCODE", "SDATE", parse_2digit_date("SDATE", 21).alias("DATE"),
                    parse_2digit_date("SDATE", 69).alias("DATE_69"))


@register("p4_drop_flags", B + f"""SELECT SITECODE, LCODE, SDATE, FIELDNAME, {r6('VALUE')} FROM obs
WHERE NOT contains(FIELDNAME, 'Q')""")
def p4_drop_flags(spark, d):
    return drop_flag_rows(obs(spark, d))


@register("p5_flag_id", B + f"""SELECT SITECODE, LCODE, SDATE, FIELDNAME, {r6('VALUE')},
  {r6("CASE WHEN regexp_matches(FIELDNAME, 'Q[1-5]') THEN VALUE END", 'FLAGID')} FROM obs""")
def p5_flag_id(spark, d):
    return with_flag_id(obs(spark, d))


@register("p6_station_key", B + """SELECT DISTINCT SITECODE, LCODE,
  SITECODE || '-' || CAST(LCODE AS VARCHAR) AS station FROM obs""")
def p6_station_key(spark, d):
    return with_station(obs(spark, d)).select("SITECODE", "LCODE", "station").distinct()


@register("p7_site_of", BC + "SELECT DISTINCT station, split_part(station, '-', 1) AS site FROM clean")
def p7_site_of(spark, d):
    return clean(spark, d).select("station", site_of("station").alias("site")).distinct()


@register("p8_between_dates", BC + f"""SELECT station, DATE, FIELDNAME, {r6('VALUE')} FROM clean
WHERE DATE BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""")
def p8_between_dates(spark, d):
    return between_dates(clean(spark, d), "DATE", "1997-01-01", "1998-12-31").select(
        "station", "DATE", "FIELDNAME", "VALUE")


@register("p9_filter_in", BC + f"""SELECT station, DATE, FIELDNAME, {r6('VALUE')} FROM clean
WHERE SITECODE IN (SELECT 'T' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') FROM nation
                   JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')""")
def p9_filter_in(spark, d):
    """Rows of the sites of one region (membership by semi join)."""
    sites = standin.region_sites(spark, d, "EUROPE")
    return filter_in(clean(spark, d), "SITECODE", sites).select("station", "DATE", "FIELDNAME", "VALUE")


def _enriched(spark, d):
    return enrich(clean(spark, d), standin.groups(spark, d),
                  trim_trait_code(standin.raw_traits(spark, d)))


_TAXA_COLS = ["station", "DATE", "FIELDNAME", "VALUE"]
_TAXA_SQL = BJ + f"SELECT station, DATE, FIELDNAME, {r6('VALUE')} FROM enr WHERE "


@register("p10_taxa_common_name", _TAXA_SQL + "DESC_COMMON = 'red plate'")
def p10_taxa_common_name(spark, d):
    return select_taxa(_enriched(spark, d), Taxa(common_name="red plate")).select(*_TAXA_COLS)


@register("p10_taxa_group", _TAXA_SQL + "IM_GROUP = 'MEDIUM'")
def p10_taxa_group(spark, d):
    return select_taxa(_enriched(spark, d), Taxa(group="MEDIUM")).select(*_TAXA_COLS)


@register("p10_taxa_predicate", _TAXA_SQL + "WINGSPAN > 40 AND Genus = 'Brand#2'")
def p10_taxa_predicate(spark, d):
    return select_taxa(_enriched(spark, d), "WINGSPAN > 40 AND Genus = 'Brand#2'").select(*_TAXA_COLS)


@register("p13_calendar_parts", BC + """SELECT DISTINCT DATE, year(DATE) AS year, month(DATE) AS month,
  monthname(DATE) AS monthname, day(last_day(DATE)) AS days_in_month FROM clean""")
def p13_calendar_parts(spark, d):
    return with_calendar_parts(clean(spark, d).select("DATE").distinct(), "DATE")


@register("p14_month_bounds", BC + """SELECT DISTINCT DATE, date_trunc('month', DATE)::DATE AS month_start,
  last_day(DATE) AS month_end FROM clean""")
def p14_month_bounds(spark, d):
    return clean(spark, d).select("DATE").distinct().select(
        "DATE", month_start("DATE").alias("month_start"), month_end("DATE").alias("month_end"))


@register("j1_enrich_left", BJ + f"""SELECT station, DATE, FIELDNAME, {r6('VALUE')}, IM_GROUP, DESC_COMMON,
  Genus, {r6('WINGSPAN')} FROM enr""")
def j1_enrich_left(spark, d):
    return _enriched(spark, d).select("station", "DATE", "FIELDNAME", "VALUE", "IM_GROUP",
                                      "DESC_COMMON", "Genus", "WINGSPAN")


@register("j2_enrich_inner", with_(OBS, CLEAN, GROUPS) + f"""SELECT station, DATE, FIELDNAME, IM_GROUP,
  {r6('VALUE')} FROM clean JOIN grp ON FIELDNAME = IM_SPEC WHERE VALUE IS NOT NULL""")
def j2_enrich_inner(spark, d):
    e = enrich(clean(spark, d), standin.groups(spark, d), how="inner")
    return e.select("station", "DATE", "FIELDNAME", "IM_GROUP", "VALUE")


@register("g2_daily_counts_group", with_(OBS, CLEAN, GROUPS) + f"""SELECT DATE, station, IM_GROUP,
  {r6('sum(VALUE)', 'count')} FROM clean JOIN grp ON FIELDNAME = IM_SPEC WHERE VALUE IS NOT NULL
GROUP BY DATE, station, IM_GROUP""")
def g2_daily_counts_group(spark, d):
    e = enrich(clean(spark, d), standin.groups(spark, d), how="inner")
    return daily_counts(e, ["station", "IM_GROUP"], "DATE", "VALUE", out="count")
