import datetime as dt

from conftest import rows
from sitewise.operators.counts import daily_facts, monthly_totals
from sitewise.operators.gaps import missing_days, missing_runs, share_over_gaps, spread_over_gaps, top_missing_runs

D = dt.date


def d(i):
    return D(2000, 1, i)


def _obs(spark):
    # sampled days 1, 2, 5, 10, 11, 14; day 11 has a null value -> unsampled
    data = [("A", d(1), "x", 1.0), ("A", d(2), "x", 2.0), ("A", d(5), "x", 9.0), ("A", d(10), "x", 20.0),
            ("A", d(11), "x", None), ("A", d(11), "y", 4.0), ("A", d(14), "x", 8.0)]
    return spark.createDataFrame(data, "k string, DATE date, FIELDNAME string, VALUE double")


def test_missing_days_and_runs(spark):
    miss = missing_days(_obs(spark), ["k"], "DATE", "VALUE")
    assert [r.DATE.day for r in miss.orderBy("DATE").collect()] == [3, 4, 6, 7, 8, 9, 11, 12, 13]
    runs = {r.DATE.day: (r.seq_id, r.STARTDATE.day, r.ENDDATE.day, r.duration, r.next_meas)
            for r in missing_runs(miss, ["k"], "DATE").collect()}
    assert runs[3] == (1, 3, 4, 2, 2) and runs[4] == (1, 3, 4, 2, 1)
    assert runs[6] == (2, 6, 9, 4, 4) and runs[11] == (3, 11, 13, 3, 3)
    top = rows(top_missing_runs(missing_runs(miss, ["k"], "DATE"), ["k"], 2), "seq_id", "duration", "rank")
    assert top == [(2, 4, 1), (3, 3, 2)]


def _spread(spark, **kw):
    obs = _obs(spark)
    runs = missing_runs(missing_days(obs, ["k"], "DATE", "VALUE"), ["k"], "DATE")
    counts = spark.createDataFrame([("A", d(1), 1.0), ("A", d(2), 2.0), ("A", d(5), 9.0), ("A", d(10), 20.0),
                                    ("A", d(11), 4.0), ("A", d(14), 8.0)], "k string, DATE date, counts double")
    return {r.DATE.day: r.counts for r in spread_over_gaps(counts, runs, ["k"], "DATE", **kw).collect()}


def test_spread_short_gap_keeps_total(spark):
    c = _spread(spark)
    assert (c[3], c[4], c[5]) == (3.0, 3.0, 3.0)          # 9 shared over 2 missing days + next day
    assert c[1] == 1.0 and c[2] == 2.0


def test_spread_long_gap_is_null_and_day_after(spark):
    c = _spread(spark)
    assert all(c[i] is None for i in (6, 7, 8, 9))          # run of 4 > 3
    assert c[10] is None                                     # day after a long run (field-script rule)
    assert _spread(spark, null_after_long_gap=False)[10] == 20.0


def test_spread_day_with_null_value_is_a_run(spark):
    c = _spread(spark)
    # day 11 had a null value, so it starts a 3-day run (11..13): days 12, 13
    # and 14 share day 14's 8 over 4; day 11 keeps its own partial count of
    # 4, divided the same way (the field scripts' rule)
    assert (c[11], c[12], c[13], c[14]) == (1.0, 2.0, 2.0, 2.0)


def test_zero_fill_of_sampled_days_without_taxon(spark):
    obs = _obs(spark)
    runs = missing_runs(missing_days(obs, ["k"], "DATE", "VALUE"), ["k"], "DATE")
    taxon = spark.createDataFrame([("A", d(1), 1.0), ("A", d(5), 9.0)], "k string, DATE date, counts double")
    z = {r.DATE.day: r.counts for r in spread_over_gaps(taxon, runs, ["k"], "DATE", zero_fill=True).collect()}
    nz = {r.DATE.day: r.counts for r in spread_over_gaps(taxon, runs, ["k"], "DATE", zero_fill=False).collect()}
    assert z[2] == 0.0 and nz[2] == 9.0                      # day 2 sampled, taxon absent: 0, or next count
    assert z[3] == 3.0 and z[5] == 3.0


def test_one_chain_equals_general_path(spark):
    """share_over_gaps (one window chain over daily_facts) and
    spread_over_gaps (separate counts and runs) give the same grid."""
    import random

    from pyspark.sql import functions as F

    from sitewise.operators.counts import daily_facts, daily_species
    from sitewise.operators.gaps import share_over_gaps

    rng = random.Random(11)
    data = []
    for k in ("A", "B", "C"):
        for i in range(1, 120):
            if rng.random() < 0.45:
                continue                                   # unsampled day
            for f in ("x", "y", "z"):
                if rng.random() < 0.5:
                    v = None if rng.random() < 0.08 else float(rng.randint(0, 9))
                    data.append((k, dt.date(2001, 1, 1) + dt.timedelta(days=i), f, v))
    obs = spark.createDataFrame(data, "k string, DATE date, FIELDNAME string, VALUE double")
    taxon = F.col("FIELDNAME") == "x"
    for zero_fill in (True, False):
        for after_long in (True, False):
            facts = daily_facts(obs, ["k"], "DATE", taxon=taxon)
            one = share_over_gaps(facts, ["k"], "DATE", max_gap=3, zero_fill=zero_fill,
                                  null_after_long_gap=after_long)
            runs = missing_runs(missing_days(obs, ["k"], "DATE", "VALUE"), ["k"], "DATE")
            counts = daily_species(obs.filter(taxon), ["k"], "DATE")
            gen = spread_over_gaps(counts, runs, ["k"], "DATE", max_gap=3, zero_fill=zero_fill,
                                   null_after_long_gap=after_long)
            a = rows(one, "k", "DATE", "counts", "duration")
            b = rows(gen, "k", "DATE", "counts", "duration")
            assert len(a) == len(b) > 100
            for x, y in zip(a, b):
                assert x[:2] == y[:2] and x[3] == y[3]
                assert (x[2] is None and y[2] is None) or abs(x[2] - y[2]) < 1e-12, (x, y)


def test_multi_site_with_checkpointed_daily_grid(spark):
    from conftest import SF_SMALL
    from sitewise.plans.catalog.common import clean
    from sitewise.plans.site import multi_site
    a = rows(multi_site(clean(spark, SF_SMALL), ["SITECODE"]), "SITECODE", "DATETIME", "decomp_deseason")
    b = rows(multi_site(clean(spark, SF_SMALL), ["SITECODE"], checkpoint_daily=True),
             "SITECODE", "DATETIME", "decomp_deseason")
    assert len(a) > 0 and len(a) == len(b)
    assert all(x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-9 for x, y in zip(a, b))


def _gap_frame(spark):
    """Random days of keys, one key null, one with a single day."""
    import random
    rng = random.Random(5)
    data = [("one", dt.date(2001, 1, 1), "x", None)]
    for k in ("A", "B", None):
        for i in range(150):
            if rng.random() < 0.6:
                data.append((k, dt.date(2001, 1, 1) + dt.timedelta(days=i), "x", None if rng.random() < 0.2 else float(i % 7)))
    return spark.createDataFrame(data, "k string, DATE date, FIELDNAME string, VALUE double")


def test_stretches_give_the_runs_of_days(spark):
    obs = _gap_frame(spark)
    args = ["k"], "DATE", "VALUE"
    by_day = missing_runs(missing_days(obs, *args), ["k"])
    by_stretch = missing_runs(missing_days(obs, *args, spans=True), ["k"], spans=True)
    assert by_day.columns == by_stretch.columns and rows(by_day) == rows(by_stretch)
    whole = missing_runs(missing_days(obs, *args, spans=True), ["k"], spans=True, days=False)
    assert rows(top_missing_runs(whole, ["k"], 3, days=False)) == rows(top_missing_runs(by_day, ["k"], 3))
    # plain count of the days
    seen, null = {}, set()
    for r in obs.collect():
        seen.setdefault(r.k, set()).add(r.DATE)
        if r.VALUE is None:
            null.add((r.k, r.DATE))
    want = [(k, lo + dt.timedelta(days=i)) for k, ds in seen.items() for lo in [min(ds)] for i in range((max(ds) - lo).days + 1)
            if lo + dt.timedelta(days=i) not in ds or (k, lo + dt.timedelta(days=i)) in null]
    assert sorted(map(str, want)) == sorted(str((r.k, r.DATE)) for r in missing_days(obs, *args).collect())


def test_gap_queries_sort_recorded_days_only(spark):
    """Days are written out above every sort and window, not below."""
    import __spark_entry__ as E
    from conftest import SF_SMALL
    for name in ("c6_missing_days", "c7_missing_runs", "c8_top_missing_runs", "c9_spread_over_gaps", "c10_spread_zero_fill",
                 "g4_monthly_totals", "g17_zero_days"):
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        if "Generate" in plan:
            assert not any(w in plan.split("Generate")[0] for w in ("Window", "Sort")), name
        else:
            assert name == "c8_top_missing_runs"


def test_series_are_not_gathered_in_few_tasks(spark):
    """The recorded days are few bytes, and each task holds the sorts of all its series."""
    import __spark_entry__ as E
    from conftest import SF_SMALL
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts > 1
    obs = _gap_frame(spark)
    miss = missing_days(obs, ["k"], "DATE", "VALUE", spans=True, deal=True)
    assert miss.rdd.getNumPartitions() == parts
    assert rows(miss) == rows(missing_days(obs, ["k"], "DATE", "VALUE", spans=True))
    for fill in (True, False):
        shared, plain = (share_over_gaps(daily_facts(obs, ["k"]), ["k"], "DATE", "counts", zero_fill=fill, deal=x) for x in (True, False))
        assert shared.rdd.getNumPartitions() == parts
        assert monthly_totals(shared, ["k"], "DATE", "counts").rdd.getNumPartitions() == parts
        assert rows(shared) == rows(plain)
    for name in ("c6_missing_days", "c7_missing_runs", "c8_top_missing_runs", "c9_spread_over_gaps", "c10_spread_zero_fill",
                 "g4_monthly_totals", "g17_zero_days"):
        assert E.queries()[name](spark, SF_SMALL).rdd.getNumPartitions() == parts, name
