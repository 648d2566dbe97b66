import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from sitewise.operators.counts import daily_counts, daily_species
from sitewise.operators.rates import (ceil_rate, daily_rate, monthly_rate, range_change,
                                      threshold_report, with_active_count)

D = dt.date


def _daily(spark):
    return spark.createDataFrame(
        [("A", D(2000, 1, 1), 2.0), ("A", D(2000, 1, 2), 4.0), ("A", D(2000, 1, 5), 9.0),
         ("A", D(2000, 1, 31), 30.0), ("B", D(2000, 1, 3), 1.0), ("B", D(2000, 1, 4), None)],
        "station string, DATE date, count double")


def test_daily_rate_drops_first_and_divides(spark):
    out = rows(daily_rate(_daily(spark), ["station"], "DATE", "count"), "station", "DATE", "interval", "value")
    assert out == [("A", D(2000, 1, 2), 1, 4.0), ("A", D(2000, 1, 5), 3, 3.0),
                   ("A", D(2000, 1, 31), 26, 30 / 26), ("B", D(2000, 1, 4), 1, None)]


def test_threshold_inclusive_and_strict(spark):
    le = daily_rate(_daily(spark), ["station"], "DATE", "count", max_interval=3, inclusive=True)
    lt = daily_rate(_daily(spark), ["station"], "DATE", "count", max_interval=3, inclusive=False)
    assert le.filter("station = 'A'").count() == 2 and lt.filter("station = 'A'").count() == 1


def test_monthly_rate_over_days_of_month(spark):
    r = daily_rate(_daily(spark), ["station"], "DATE", "count").filter("station = 'A'")
    m = monthly_rate(r, ["station"], "DATE", "value").first()
    assert m.date == D(2000, 1, 31)
    assert abs(m.value - (4.0 + 3.0 + 30 / 26) / 31) < 1e-12


def test_ceil_rate_first_is_one_day(spark):
    out = rows(ceil_rate(_daily(spark).filter("station = 'A'"), ["station"], "DATE", "count"), "DATE", "rate")
    assert out == [(D(2000, 1, 1), 2), (D(2000, 1, 2), 4), (D(2000, 1, 5), 3), (D(2000, 1, 31), 2)]


def test_daily_counts_and_species(spark):
    obs = spark.createDataFrame(
        [("A", D(2000, 1, 1), "x", 1.0), ("A", D(2000, 1, 1), "y", None), ("A", D(2000, 1, 1), None, 2.0),
         ("A", D(2000, 1, 2), "x", 0.0), ("A", D(2000, 1, 3), "x", None)],
        "station string, DATE date, FIELDNAME string, VALUE double")
    c = {r.DATE: r["count"] for r in daily_counts(obs, ["station"]).collect()}
    assert c[D(2000, 1, 1)] is None and c[D(2000, 1, 2)] == 0.0
    s = {r.DATE: (r.counts, r.n_species) for r in daily_species(obs, ["station"]).collect()}
    # nulls skipped in the total; a null name counts as one more name
    assert s[D(2000, 1, 1)] == (3.0, 3)
    assert s[D(2000, 1, 2)] == (0.0, 0) and s[D(2000, 1, 3)] == (0.0, 0)


def test_threshold_report_and_range_change(spark):
    iv = daily_rate(_daily(spark), ["station"], "DATE", "count").filter("station = 'A'")
    rep = threshold_report(iv, ["station"], 5).first()
    assert (rep.nobs, rep.interval_min, rep.interval_max, rep.nlessthresh) == (3, 1, 26, 2)
    assert abs(rep.percent_kept - 200 / 3) < 1e-9
    rc = range_change(iv, ["station"], "count", F.col("interval") < 5).first()
    assert (rc.thresh_min, rc.thresh_max, rc["min"], rc["max"]) == (4.0, 9.0, 4.0, 30.0)


def test_active_count(spark):
    df = spark.createDataFrame([("T1", 1, D(2000, 1, 1)), ("T1", 2, D(2000, 1, 1)), ("T1", 1, D(2000, 1, 2))],
                               "SITECODE string, LCODE int, DATE date")
    out = rows(with_active_count(df), "LCODE", "DATE", "nactive")
    assert out == [(1, D(2000, 1, 1), 2), (1, D(2000, 1, 2), 1), (2, D(2000, 1, 1), 2)]
