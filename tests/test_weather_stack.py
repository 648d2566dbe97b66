import datetime as dt

from conftest import rows
from sitewise.operators.stack import stack_series
from sitewise.operators.weather import weather_for_stations

D = dt.date


def _inputs(spark):
    weather = spark.createDataFrame(
        [("T1", D(2000, 1, d), f, float(d)) for d in range(1, 11) for f in ("RAIN", "DRYTMP")] +
        [("T9", D(2000, 1, 5), "RAIN", 99.0)],
        "SITECODE string, DATE date, FIELDNAME string, daily double")
    obs = spark.createDataFrame(
        [("T1", "T1-1", D(2000, 1, 3)), ("T1", "T1-1", D(2000, 1, 5)), ("T1", "T1-2", D(2000, 1, 9)),
         ("T1", "T1-2", D(2000, 1, 12))],
        "SITECODE string, station string, DATE date")
    return weather, obs


def test_weather_within_each_stations_dates(spark):
    weather, obs = _inputs(spark)
    out = weather_for_stations(weather, obs)
    got = rows(out.filter("value_type = 'RAIN'"), "station", "date")
    assert got == [("T1-1", D(2000, 1, 3)), ("T1-1", D(2000, 1, 4)), ("T1-1", D(2000, 1, 5)),
                   ("T1-2", D(2000, 1, 9)), ("T1-2", D(2000, 1, 10))]
    assert out.count() == 10                                  # both fields; site T9 has no station


def test_weather_types_none_means_all(spark):
    weather, obs = _inputs(spark)
    assert weather_for_stations(weather, obs, types=["RAIN"]).count() == 5
    assert weather_for_stations(weather, obs, types=None).count() == 10


def test_stack_series(spark):
    a = spark.createDataFrame([("x", D(2000, 1, 31), 1.0)], "station string, date date, value double")
    b = spark.createDataFrame([(D(2000, 12, 31), 7.5)], "DATETIME date, ANNUAL double")
    out = rows(stack_series({"moth": (a, "station", "date", "value"), "perch": (b, None, "DATETIME", "ANNUAL")}))
    assert out == [("moth", "x", D(2000, 1, 31), 1.0), ("perch", "perch", D(2000, 12, 31), 7.5)]


def test_weather_join_is_not_gathered_in_one_task(spark):
    """The months of the stations are few bytes and many results."""
    weather, obs = _inputs(spark)
    assert weather_for_stations(weather, obs).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
