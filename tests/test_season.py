import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from sitewise.operators.season import (classical_decompose, deseason_ma, deseason_median,
                                       season_table, seasonal_component, standardise)
from sitewise.operators.smooth import moving_average, seasonal_diff
from sitewise.operators.spectrum import periodogram


def _series(spark, f, n=48, keys=("A", "B")):
    data = []
    for k in keys:
        for i in range(n):
            y, m = 2000 + i // 12, i % 12 + 1
            data.append((k, dt.date(y, m, 1), float(f(i, k))))
    return spark.createDataFrame(data, "k string, d date, v double")


def test_ma_of_linear_series_detrends_to_zero(spark):
    df = moving_average(_series(spark, lambda i, k: 3 * i + 1), ["k"], "d", "v", "2x12")
    vals = [(r.v, r.ma2x12) for r in df.filter("k = 'A'").orderBy("d").collect()]
    assert all(ma is None for _, ma in vals[:6] + vals[-6:])
    assert all(abs(v - ma) < 1e-9 for v, ma in vals[6:-6])


def test_ma_null_inside_window_gives_null(spark):
    df = _series(spark, lambda i, k: i).withColumn("v", F.when(F.month("d") == 7, None).otherwise(F.col("v")))
    out = moving_average(df, ["k"], "d", "v", "2x12").filter("k = 'A'").orderBy("d").collect()
    assert all(r.ma2x12 is None for r in out)   # every 13-month window holds a July


def test_trailing_ma_and_seasonal_diff(spark):
    df = seasonal_diff(moving_average(_series(spark, lambda i, k: i), ["k"], "d", "v", "12"), ["k"], "d", "v")
    r = df.filter("k = 'A'").orderBy("d").collect()
    assert r[10].ma12 is None and abs(r[11].ma12 - 5.5) < 1e-12
    assert r[11].diff12 is None and r[12].diff12 == 12.0


def test_centred_components_sum_to_zero(spark):
    df = seasonal_component(_series(spark, lambda i, k: (i % 12) ** 2 + (5 if k == "B" else 0)), ["k"], "d", "v")
    comps = df.select("k", "month", "std_seas").distinct().groupBy("k").agg(F.sum("std_seas").alias("s")).collect()
    assert all(abs(r.s) < 1e-9 for r in comps)


def test_deseason_removes_pure_season(spark):
    base = _series(spark, lambda i, k: 10 + np.sin(2 * np.pi * (i % 12) / 12))
    for out, col in ((classical_decompose(base, ["k"], "d", "v"), "decomp_deseason"),
                     (deseason_median(base, ["k"], "d", "v"), "deseason")):
        vals = [r[col] for r in out.collect()]
        assert max(vals) - min(vals) < 1e-9


def test_deseason_ma_and_standardise(spark):
    base = _series(spark, lambda i, k: i + 3 * ((i % 12) == 6))
    ds = deseason_ma(base, ["k"], "d", "v")
    july = ds.filter("month = 7 and k = 'A'").select("season_mean").first()[0]
    assert july > 2.5
    st = standardise(classical_decompose(base, ["k"], "d", "v"), ["k"], "d", "decomp_deseason")
    assert st.filter(F.col("decomp_deseason_std").isNotNull()).count() == 96


def test_season_table(spark):
    t = season_table(_series(spark, lambda i, k: i, n=24), ["k"], "d", "v")
    r = t.filter("k = 'A' and year = 2001").first()
    assert r.m01 == 12.0 and r.m12 == 23.0


def test_periodogram_peak_and_scaling(spark):
    for n in (2, 3, 30, 31):
        x = np.random.default_rng(n).normal(size=n)
        got = periodogram(_series(spark, lambda i, k: float(x[i]), n=n), ["k"], "d", "v").filter("k = 'A'").orderBy("freq").collect()
        fft = np.fft.fft(x - x.mean())[1:n // 2 + 1]
        assert np.allclose([r.freq for r in got], np.arange(1, n // 2 + 1) / n)
        assert np.allclose([r.spec for r in got], 2 / n * np.abs(fft) ** 2)
    assert periodogram(_series(spark, lambda i, k: 1.0, n=1), ["k"], "d", "v").count() == 0
    pg = periodogram(_series(spark, lambda i, k: np.cos(2 * np.pi * i / 12)), ["k"], "d", "v")
    assert pg.filter("k = 'A'").count() == 24
