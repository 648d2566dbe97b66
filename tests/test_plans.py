"""Checks on physical plans: shuffles, single-partition steps, pushdown and
column pruning.  They guard the scale properties the README claims."""

import os
import re
import tempfile

import pytest

from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _hash_exchanges(plan: str) -> int:
    return sum(1 for line in plan.split("\n")
               if re.search(r"\bExchange (hashpartitioning|rangepartitioning)", line) and "Reused" not in line)


def test_no_query_funnels_rows_into_one_partition(spark):
    from sitewise.plans import catalog, registry  # noqa: F401
    for name, fn in registry.QUERIES.items():
        plan = _plan(registry.finished(fn)(spark, SF_SMALL))
        assert "SinglePartition" not in plan, name
        assert not re.search(r"Window \[.*\], \[\], \[", plan), name     # every window is partitioned


@pytest.mark.parametrize("name", ["g6_monthly_rate", "c5_interpolate", "d6_deseason_ma",
                                  "c9_spread_over_gaps", "d14_multi_site", "c4_fill_month_median"])
def test_series_pipelines_shuffle_twice(spark, name):
    """One shuffle for the daily aggregate and one for the key windows; every
    later grouping by (key, month) and window by (key, ...) reuses it."""
    import __spark_entry__ as E
    assert _hash_exchanges(_plan(E.queries()[name](spark, SF_SMALL))) == 2


def test_periodogram_adds_no_shuffle(spark):
    """The transform runs on the partitioning of the key windows."""
    import __spark_entry__ as E
    plan = _plan(E.queries()["d12_periodogram"](spark, SF_SMALL))
    assert "FlatMapGroupsInPandas" in plan and _hash_exchanges(plan) == 2


def test_stored_series_need_no_exchange(spark, tmp_path):
    """Station and site pipelines over bucketed tables."""
    from sitewise.plans import site, station
    from sitewise.plans.catalog.common import clean
    from sitewise.sources.store import store_series
    c = clean(spark, SF_SMALL)
    kept = store_series(c, "kept_by_station", ["station"], "DATE", 4, str(tmp_path / "a"))
    rate = station.interpolated_monthly(station.monthly_abundance_rate(kept))
    assert "Exchange" not in _plan(rate)
    want = station.interpolated_monthly(station.monthly_abundance_rate(c))
    assert sorted(map(str, rate.collect())) == sorted(map(str, want.collect()))
    by_site = store_series(c, "kept_by_site", ["SITECODE"], "DATE", 4, str(tmp_path / "b"))
    assert "Exchange" not in _plan(site.multi_site(by_site, ["SITECODE"]))
    assert store_series(c.limit(0), "kept_by_site", ["SITECODE"], "DATE", 4, str(tmp_path / "b")).count() == 0


def test_no_plan_depends_on_the_number_of_cores():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "sitewise")
    for folder, _, names in os.walk(root):
        for n in names:
            if n.endswith(".py"):
                text = open(os.path.join(folder, n)).read()
                assert "defaultParallelism" not in text and "except Exception" not in text, n


def test_filters_reach_the_parquet_scan(spark):
    from sitewise.operators.filters import between_dates, filter_in
    from sitewise.plans.catalog.common import clean
    out = os.path.join(tempfile.mkdtemp(prefix="sitewise-plan-"), "obs")
    clean(spark, SF_SMALL).write.mode("overwrite").parquet(out)
    df = filter_in(between_dates(spark.read.parquet(out), "DATE", "1997-01-01", "1997-12-31"),
                   "SITECODE", ["T01", "T02"]).select("station", "DATE", "VALUE")
    plan = _plan(df)
    pushed = plan[plan.index("PushedFilters: ["):]          # long filter lists are cut short in the text
    assert "GreaterThanOrEqual(DATE" in pushed and "LessThanOrEqual(DATE" in pushed and "In(SITEC" in pushed
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "FIELDNAME" not in schema and "LCODE" not in schema          # pruned columns are not read


def test_scan_reads_only_needed_columns(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["g6_monthly_rate"](spark, SF_SMALL))
    li = [m for m in re.findall(r"FileScan parquet \[([^\]]*)\]", plan) if "l_shipdate" in m][0]
    assert "l_extendedprice" not in li and "l_discount" not in li and "l_tax" not in li


def test_checkpoint_folder(spark, tmp_path):
    """The folder already set is used; a session without one is refused."""
    from sitewise.session import ensure_checkpoint_dir

    class Context:
        def __init__(self, folder):
            self.folder = folder

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, folder, setting):
            self.sparkContext = Context(folder)
            self.conf = {"spark.checkpoint.dir": setting} if setting else {}
            self.conf = type("Conf", (), {"get": lambda _, k, default=None, c=self.conf: c.get(k, default)})()

    assert ensure_checkpoint_dir(Session("/own", "/setting")) == "/own"
    s = Session(None, "/setting")
    assert ensure_checkpoint_dir(s) == "/setting" == s.sparkContext.folder
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session(None, None))
