import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from sitewise.functions import (drop_flag_rows, parse_2digit_date, r_max, r_mean, r_sd, r_sum,
                                site_of, station_key, with_calendar_parts, with_flag_id, year_end)

D = dt.date


def test_two_digit_year_pivot_69(spark):
    df = spark.createDataFrame([(t,) for t in ["29-Feb-96", "05-Jan-93", "31-Dec-68", "01-Jan-69",
                                                "29-Feb-00", "05-jan-93", "bad", None, "31-Feb-95"]],
                               "s string")
    got = dict((r.s, r.d) for r in df.select("s", parse_2digit_date("s").alias("d")).collect())
    assert got["29-Feb-96"] == D(1996, 2, 29)
    assert got["05-Jan-93"] == D(1993, 1, 5)
    assert got["31-Dec-68"] == D(2068, 12, 31)
    assert got["01-Jan-69"] == D(1969, 1, 1)
    assert got["29-Feb-00"] == D(2000, 2, 29)
    assert got["05-jan-93"] == D(1993, 1, 5)
    assert got["bad"] is None and got[None] is None and got["31-Feb-95"] is None


def test_two_digit_year_pivot_21(spark):
    df = spark.createDataFrame([("05-Jan-21",), ("05-Jan-20",), ("17-Mar-99",)], "s string")
    got = dict((r.s, r.d) for r in df.select("s", parse_2digit_date("s", 21).alias("d")).collect())
    assert got == {"05-Jan-21": D(1921, 1, 5), "05-Jan-20": D(2020, 1, 5), "17-Mar-99": D(1999, 3, 17)}


def test_leap_day_missing_in_earlier_century(spark):
    # 29 Feb 2000 exists, 29 Feb 1900 does not: with pivot 0, "00" is 1900
    df = spark.createDataFrame([("29-Feb-00",)], "s string")
    assert df.select(parse_2digit_date("s", 0)).first()[0] is None


def test_year_end_and_calendar_parts(spark):
    df = spark.createDataFrame([(1996, D(1996, 2, 10)), (1997, D(1997, 2, 10))], "y int, d date")
    out = with_calendar_parts(df.withColumn("ye", year_end("y")), "d")
    r = {x.y: x for x in out.collect()}
    assert r[1996].ye == D(1996, 12, 31)
    assert (r[1996].days_in_month, r[1997].days_in_month) == (29, 28)
    assert r[1996].monthname == "February" and r[1996].month == 2


def test_station_key_null_and_site_of(spark):
    df = spark.createDataFrame([("T01", 1), ("T02", None), (None, 3)], "SITECODE string, LCODE int")
    got = [r[0] for r in df.select(station_key()).collect()]
    assert got == ["T01-1", None, None]
    assert spark.range(1).select(site_of(F.lit("T10-3"))).first()[0] == "T10"


def test_flags(spark):
    df = spark.createDataFrame([("Q1", 3.0), ("Q7", 1.0), ("XQ", 2.0), ("123", 5.0), (None, 1.0)],
                               "FIELDNAME string, VALUE double")
    assert rows(drop_flag_rows(df), "FIELDNAME") == [("123",)]
    got = dict((r.FIELDNAME, r.FLAGID) for r in with_flag_id(df).collect())
    assert got["Q1"] == 3.0 and got["Q7"] is None and got["123"] is None and got[None] is None


def test_null_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("c", 2.0), ("c", 4.0), ("d", 5.0)],
                               "k string, v double")
    out = {r.k: r for r in df.groupBy("k").agg(
        r_sum("v").alias("s"), r_sum("v", na_rm=True).alias("s_rm"), r_mean("v").alias("m"),
        r_max("v").alias("mx"), r_sd("v").alias("sd")).collect()}
    assert out["a"].s is None and out["a"].s_rm == 1.0 and out["a"].m is None and out["a"].mx is None
    assert out["b"].s_rm == 0          # sum of nothing, nulls skipped, is 0
    assert out["c"].s == 6.0 and out["c"].m == 3.0
    assert out["d"].sd is None         # sd of one value
