import datetime as dt

from conftest import rows
from sitewise.operators.calendar import (all_dates_present, complete_days, complete_months,
                                         fill_month_median, interpolate_linear, missing_months)

D = dt.date


def _monthly(spark):
    return spark.createDataFrame(
        [("A", D(2000, 1, 1), 1.0), ("A", D(2000, 4, 1), 4.0), ("B", D(2000, 2, 1), 2.0)],
        "k string, m date, v double")


def test_complete_months_fill_and_idempotent(spark):
    c = complete_months(_monthly(spark), ["k"], "m", fill={"v": 0})
    assert rows(c, "k", "m", "v") == [("A", D(2000, 1, 1), 1.0), ("A", D(2000, 2, 1), 0.0),
                                      ("A", D(2000, 3, 1), 0.0), ("A", D(2000, 4, 1), 4.0),
                                      ("B", D(2000, 2, 1), 2.0)]
    assert rows(complete_months(c, ["k"], "m", fill={"v": 0}), "k", "m", "v") == rows(c, "k", "m", "v")


def test_month_ends_never_overflow(spark):
    df = spark.createDataFrame([("A", D(2000, 1, 31), 1.0), ("A", D(2000, 4, 30), 2.0)], "k string, m date, v double")
    got = [r.m for r in complete_months(df, ["k"], "m", anchor="end").orderBy("m").collect()]
    assert got == [D(2000, 1, 31), D(2000, 2, 29), D(2000, 3, 31), D(2000, 4, 30)]


def test_missing_and_all_present(spark):
    assert rows(missing_months(_monthly(spark), ["k"], "m"), "k", "m") == [("A", D(2000, 2, 1)), ("A", D(2000, 3, 1))]
    ap = {r.k: (r.n_months, r.n_missing, r.all_present) for r in all_dates_present(_monthly(spark), ["k"], "m").collect()}
    assert ap == {"A": (4, 2, False), "B": (1, 0, True)}


def test_complete_days_between_bounds(spark):
    df = spark.createDataFrame([("A", D(2000, 1, 30), 1.0), ("A", D(2000, 2, 1), 2.0), ("A", D(2000, 2, 3), 3.0)],
                               "k string, d date, v double")
    assert complete_days(df, ["k"], "d").count() == 5
    # rows outside [lo, hi] are left out first; the calendar spans the rows inside
    got = rows(complete_days(df, ["k"], "d", lo="2000-01-31", hi="2000-02-03"), "d", "v")
    assert got == [(D(2000, 2, 1), 2.0), (D(2000, 2, 2), None), (D(2000, 2, 3), 3.0)]


def test_interpolation_on_day_axis(spark):
    df = spark.createDataFrame([("A", D(2000, 1, 31), 0.0), ("A", D(2000, 3, 31), 60.0), ("A", D(2000, 4, 30), None),
                                ("A", D(2000, 5, 31), 10.0), ("B", D(2000, 6, 30), 5.0)], "k string, d date, v double")
    out = {(r.k, r.d): (r.v, r.missing) for r in interpolate_linear(df, ["k"], "d", "v").collect()}
    assert out[("A", D(2000, 2, 29))] == (29 * 60.0 / 60, True)     # 29 of 60 days
    assert out[("A", D(2000, 4, 30))][1] is True                     # observed null: interpolated
    assert abs(out[("A", D(2000, 4, 30))][0] - (60 + (10 - 60) * 30 / 61)) < 1e-12
    assert out[("B", D(2000, 6, 30))] == (5.0, False)                # one-month station: no neighbour needed


def test_fill_month_median(spark):
    df = spark.createDataFrame([("A", D(2000, 1, 1), 1.0), ("A", D(2001, 1, 1), 3.0), ("A", D(2002, 1, 1), 10.0),
                                ("A", D(2000, 2, 1), 7.0), ("A", D(2002, 2, 1), None)], "k string, m date, v double")
    out = {r.m: (r.v, r.missing) for r in fill_month_median(df, ["k"], "m", "v").collect()}
    assert out[D(2001, 2, 1)] == (7.0, True) and out[D(2002, 2, 1)] == (7.0, True)
    assert out[D(2001, 1, 1)] == (3.0, False)


def test_repeated_rows_do_not_change_the_calendar(spark):
    df = spark.createDataFrame([("A", D(2000, 1, 1)), ("A", D(2000, 1, 1)), ("A", D(2000, 1, 15)),
                                ("A", D(2000, 4, 1))], "k string, m date")
    assert rows(missing_months(df, ["k"], "m"), "k", "m") == [("A", D(2000, 2, 1)), ("A", D(2000, 3, 1))]
    r = all_dates_present(df, ["k"], "m").first()
    assert (r.n_months, r.n_missing, r.all_present) == (4, 2, False)
