import os
import sys

import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"SITECODE", "station", "date", "value", "value_type"}
    from sitewise.plans import registry
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and set(registry.QUERIES) <= set(q) and len(registry.QUERIES) >= 95
    assert sorted(set(registry.QUERIES) - set(o)) == ["k3_trap_weather_joint"]


FAST = ["g6_monthly_rate", "c5_interpolate", "c9_spread_over_gaps", "d4_classical_decompose",
        "d12_periodogram", "k3_joint_changepoints", "j3_weather_range", "g13_species_by_trap"]


@pytest.mark.parametrize("name", FAST)
def test_oracle_agreement_small(spark, name):
    import __spark_entry__ as E
    from oracle_check import compare, duck
    r = compare(spark, duck(SF_SMALL), name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert r["status"] == "ok", r


def test_grouped_queries_run_outside_the_repo():
    """Executors import nothing from the repo: the grouped pandas functions
    travel by value.  Run from another folder, in a fresh JVM."""
    import subprocess
    import tempfile
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
print("ROWS", E.queries()["k1_changepoints"](spark, {SF_SMALL!r}).count(),
      E.queries()["d12_periodogram"](spark, {SF_SMALL!r}).count())
"""
    r = subprocess.run([sys.executable, "-c", script], cwd=tempfile.mkdtemp(prefix="sitewise-out-"),
                       capture_output=True, text=True, timeout=600)
    assert "ROWS" in r.stdout, r.stderr[-2000:]
