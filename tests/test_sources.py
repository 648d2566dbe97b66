import datetime as dt
import os
import tempfile

import pytest

from sitewise.sources.readers import (clean_observations, read_annual_series, read_observations,
                                      read_traits, write_report)

# An invented annual series: missing years, a second site, a second name.
ANNUAL = "YEAR,SITE,DETERMINAND,ANNUAL_AVG_ABUNDANCE\n" + "".join(
    f"{y},{site},{name},{v}\n" for site, name, y, v in
    [("Lake A", "Fish one", 1984 + i, 2.5 * i + 1) for i in range(18) if i not in (7, 8)]
    + [("Lake B", "Fish one", 1996, 100.0), ("Lake A", "Fish two", 1996, 200.0), ("Lake A", "Fish one", 1983, "NA")])


def _write(text, name, crlf=False):
    d = tempfile.mkdtemp(prefix="sitewise-test-")
    p = os.path.join(d, name)
    with open(p, "w", newline="") as f:
        f.write(text.replace("\n", "\r\n") if crlf else text)
    return d, p


def test_annual_series_window(spark):
    _, p = _write(ANNUAL, "annual.csv", crlf=True)
    df = read_annual_series(spark, p, site="Lake A", determinand="Fish one", start="1988-12-31", end="1999-02-21")
    got = sorted((r.DATETIME.year, r.ANNUAL_AVG_ABUNDANCE) for r in df.collect())
    assert [y for y, _ in got] == [1988, 1989, 1990, 1993, 1994, 1995, 1996, 1997, 1998]
    assert all(r.DATETIME.month == 12 and r.DATETIME.day == 31 for r in df.collect())
    assert dict(got)[1996] == 31.0
    whole = read_annual_series(spark, p, site="Lake A", determinand="Fish one").collect()
    assert [r.ANNUAL_AVG_ABUNDANCE for r in whole if r.DATETIME.year == 1983] == [None]


def test_observation_csv_schema_and_cleaning(spark):
    text = ("SITECODE,LCODE,SDATE,FIELDNAME,VALUE\n"
            "T01,1,05-Jan-93,A1,3\nT01,1,05-Jan-93,Q1,2\nT01,2,bad,A1,\nT02,1,31-Dec-68,XX,0\n")
    d, p = _write(text, "ECN_IM1.csv")
    obs = read_observations(spark, dataset="moth", root=d)
    assert [f.dataType.simpleString() for f in obs.schema.fields] == ["string", "int", "string", "string", "double"]
    c = {(r.station, r.FIELDNAME): r for r in clean_observations(obs).collect()}
    assert set(c) == {("T01-1", "A1"), ("T02-1", "XX")}
    assert c[("T01-1", "A1")].DATE == dt.date(1993, 1, 5)
    assert c[("T02-1", "XX")].DATE == dt.date(2068, 12, 31)


def test_missing_values_and_rejects(spark):
    """NA and NaN are missing values; rows without site, trap or date are
    returned with a reason and none is lost."""
    from sitewise.sources.readers import rejected_observations
    text = ("SITECODE,LCODE,SDATE,FIELDNAME,VALUE\nT01,1,05-Jan-93,A1,NA\nT01,1,06-Jan-93,A1,NaN\nNA,1,05-Jan-93,A1,1\n"
            "T01,NA,05-Jan-93,A1,2\nT01,1,99-Foo-93,A1,3\nT01,1,NA,A1,4\nT01,1,07-Jan-93,A1,5\n")
    _, p = _write(text, "obs.csv")
    obs = read_observations(spark, p)
    good = {r.DATE.day: r.VALUE for r in clean_observations(obs).collect()}
    assert good == {5: None, 6: None, 7: 5.0}
    bad = sorted((r.reason, r.VALUE) for r in rejected_observations(obs).collect())
    assert bad == [("bad date", 3.0), ("bad date", 4.0), ("no site", 1.0), ("no trap", 2.0)]
    assert len(good) + len(bad) == obs.count()


def test_weather_reader(spark):
    from sitewise.sources.readers import read_weather
    df = spark.createDataFrame([("T01", dt.date(2000, 1, 1), "rain", 1.5)], "SITECODE string, DATE date, FIELDNAME string, daily double")
    out = os.path.join(tempfile.mkdtemp(prefix="sitewise-test-"), "weather")
    write_report(df, out, fmt="parquet")
    assert read_weather(spark, out).collect() == df.collect()


def test_pivots_lose_no_row(spark):
    from sitewise.operators.counts import pivot_fields, species_by_trap
    df = spark.createDataFrame([("A1", "T1", 1.0), ("A1", "T99", 2.0), ("A2", "T99", 3.0), ("A2", None, 4.0), ("A1", "T1", 5.0)],
                               "FIELDNAME string, TRAP string, v double")
    wide = {r.FIELDNAME: r.asDict() for r in species_by_trap(df, ["T1", "T2"]).collect()}
    assert wide["A1"] == {"FIELDNAME": "A1", "T1": 2, "T2": None, "other": 1} and wide["A2"]["other"] == 2
    p = {r.FIELDNAME: r for r in pivot_fields(df, ["FIELDNAME"], "TRAP", "v", ["T1"]).collect()}
    assert p["A1"].T1 == 1.0 and p["A1"].n_other == 1 and p["A2"].n_other == 2


def test_taxa_by_common_name_as_text(spark):
    from sitewise.operators.filters import select_taxa
    df = spark.createDataFrame([("red plate", "G", 1.0), ("blue plate", "M", 50.0)], "DESC_COMMON string, IM_GROUP string, WINGSPAN double")
    assert [r.WINGSPAN for r in select_taxa(df, "red plate").collect()] == [1.0]
    assert [r.WINGSPAN for r in select_taxa(df, "M").collect()] == [50.0]
    assert [r.WINGSPAN for r in select_taxa(df, "WINGSPAN > 40 AND IM_GROUP = 'M'").collect()] == [50.0]


def test_unknown_dataset_is_an_error(spark):
    with pytest.raises(ValueError):
        read_observations(spark, dataset="beetle", root="/nowhere")


def test_traits_code_cut_and_report_round_trip(spark):
    text = "IM_CODE,Genus,species,COMMON_NAME,Family,WINGSPAN\nIM_123,Agrotis,exclamationis,Heart and Dart,Noctuidae,40\n"
    _, p = _write(text, "traits.csv")
    t = read_traits(spark, p).first()
    assert t.IM_CODE == "123" and t.WINGSPAN == 40.0
    out = os.path.join(tempfile.mkdtemp(prefix="sitewise-test-"), "report")
    write_report(read_traits(spark, p), out)
    assert spark.read.option("header", True).csv(out).first().IM_CODE == "123"


def test_dimension_reader_explicit_text_schema(spark):
    from sitewise.sources.readers import GROUPS_SCHEMA, read_dimension
    _, p = _write("IM_SPEC,IM_GROUP,DESC_COMMON,DESC_LATIN\n0001,G,Heart and Dart,Agrotis exclamationis\n", "groups.csv")
    g = read_dimension(spark, p, GROUPS_SCHEMA).first()
    assert g.IM_SPEC == "0001" and g.IM_GROUP == "G"     # text stays text: no leading-zero loss


def test_fortnightly_series_pivot_21(spark):
    from sitewise.sources.readers import read_fortnightly_series
    text = ("DATE,VARIABLE,sign_if_LT_LOD,VALUE\n05-Jan-93,PO4P,,1.5\n19-Jan-93,PO4P,<,0.5\n"
            "17-Mar-20,PO4P,,2.0\n17-Mar-21,PO4P,,9.0\n05-Jan-93,NO3N,,7.0\n")
    _, p = _write(text, "po4p.csv")
    got = sorted((r.DATETIME, r.VALUE) for r in read_fortnightly_series(spark, p, variable="PO4P").collect())
    assert got == [(dt.date(1921, 3, 17), 9.0), (dt.date(1993, 1, 5), 1.5), (dt.date(1993, 1, 19), 0.5),
                   (dt.date(2020, 3, 17), 2.0)]
    w = read_fortnightly_series(spark, p, variable="PO4P", start="1989-12-31", end="1999-02-21")
    assert w.count() == 2


def test_malformed_fields_are_named(spark):
    """Bad numbers and rows of another length come back with what they hold,
    whatever columns a query reads."""
    from sitewise.sources.readers import malformed, rejected_observations
    text = ("SITECODE,LCODE,SDATE,FIELDNAME,VALUE\nT01,1,05-Jan-93,A1,12x\nT01,1,06-Jan-93,A1,7\nT01,1?,05-Jan-93,A1,1\n"
            "T01,1,07-Jan-93,A1,NA\nT01,1,08-Jan-93,A1,5,6\nT01,1,09-Jan-93\nT01,1,40-Jan-93,A1,x\n")
    _, p = _write(text, "obs.csv")
    obs = read_observations(spark, p, problems=True)
    assert obs.count() == 7
    assert sorted(r._problem for r in malformed(obs).select("_problem").collect()) == [
        "LCODE: 1?", "VALUE: 12x", "VALUE: x", "row: T01,1,08-Jan-93,A1,5,6", "row: T01,1,09-Jan-93"]
    bad = sorted((r.reason, r._problem) for r in rejected_observations(obs).collect())
    assert bad == [("bad date", "VALUE: x"), ("malformed", "VALUE: 12x"), ("malformed", "row: T01,1,08-Jan-93,A1,5,6"),
                   ("malformed", "row: T01,1,09-Jan-93"), ("no trap", "LCODE: 1?")]
    good = {r.DATE.day: r.VALUE for r in clean_observations(obs).filter("FIELDNAME = 'A1'").collect()}
    assert good == {5: None, 6: 7.0, 7: None, 8: 5.0}
    plain = {(r.SDATE, r.VALUE) for r in read_observations(spark, p).collect()}
    assert plain == {(r.SDATE, r.VALUE) for r in obs.collect()}


def test_malformed_fields_of_other_readers(spark):
    from sitewise.sources.readers import malformed, read_fortnightly_series, read_weather
    _, p = _write("YEAR,SITE,DETERMINAND,ANNUAL_AVG_ABUNDANCE\n19x4,A,f,1\n1985,A,f,?\n1986,A,f,2\n", "a.csv")
    a = read_annual_series(spark, p, site="A", start="1985-01-01", problems=True)
    assert sorted(r._problem for r in malformed(a).collect()) == ["ANNUAL_AVG_ABUNDANCE: ?", "YEAR: 19x4"] and a.count() == 3
    _, p = _write("DATE,VARIABLE,sign_if_LT_LOD,VALUE\n05-Jan-93,P,,1.5\n05-Foo-93,P,<,0.5\n06-Jan-93,P,,1..5\n", "f.csv")
    f = read_fortnightly_series(spark, p, variable="P", problems=True)
    assert sorted(r._problem for r in malformed(f).collect()) == ["DATE: 05-Foo-93", "VALUE: 1..5"]
    _, p = _write("SITECODE,DATE,FIELDNAME,daily\nT01,2000-01-01,rain,1\nT01,2000-02-30,rain,1\n", "w.csv")
    assert [r._problem for r in malformed(read_weather(spark, p, "csv", problems=True)).collect()] == ["DATE: 2000-02-30"]
    df = spark.createDataFrame([("T01", dt.date(2000, 1, 1), "rain", 1.5)], "SITECODE string, DATE date, FIELDNAME string, daily double")
    out = os.path.join(tempfile.mkdtemp(prefix="sitewise-test-"), "weather")
    write_report(df, out, fmt="parquet")
    assert read_weather(spark, out, problems=True).first()._problem is None


def test_ordered_report(spark):
    """The part files, one behind the other, are in order, whatever their
    number; equal keys and nulls keep their rows."""
    import glob

    from sitewise.sources.readers import read_ordered, write_ordered
    rows_ = [(f"s{i % 37:02d}" if i % 41 else None, i * 7 % 5000, f"v{i}") for i in range(5000)]
    df = spark.createDataFrame(rows_, "k string, n int, v string").repartition(9)
    out = os.path.join(tempfile.mkdtemp(prefix="sitewise-test-"), "report")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_ordered(df, out, ["k", "n"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(glob.glob(out + "/part-*"))
    lines = [line.rstrip("\n").split(",") for f in files for line in open(f)]
    assert len(files) > 3 and len(lines) == 5000
    keys = [(k if k != '""' else "", int(n)) for k, n, _ in lines]
    assert keys == sorted(keys)
    back = read_ordered(spark, out, "k string, n int, v string").orderBy("line").collect()
    assert [r.line for r in back] == list(range(1, 5001)) and [r.v for r in back] == [v for *_, v in lines]
    write_ordered(df.limit(0), out, ["k", "n"])
    assert read_ordered(spark, out, "k string, n int, v string").count() == 0


def test_trap_columns_in_slices(spark):
    from sitewise.operators.counts import species_by_trap, species_by_trap_slices, trap_columns
    df = spark.createDataFrame([(f"A{i % 3}", f"T{i % 7:02d}") for i in range(100)] + [("A9", "T99"), ("A9", None), ("A0", "T99")],
                               "FIELDNAME string, TRAP string")
    dim = spark.createDataFrame([(f"T{i:02d}",) for i in range(8)] * 2 + [(None,)], "TRAP string")
    cols = trap_columns(dim)
    assert cols == [f"T{i:02d}" for i in range(8)]
    whole = {r.FIELDNAME: r.asDict() for r in species_by_trap(df, cols).collect()}
    for width in (1, 3, 8, 100):
        parts = species_by_trap_slices(df, cols, width)
        assert [c for p in parts for c in p.columns if c not in ("FIELDNAME", "other")] == cols
        joined: dict = {}
        for p in parts:
            for r in p.collect():
                joined.setdefault(r.FIELDNAME, {}).update(r.asDict())
        assert joined == whole


def _expressions(df):
    """Expressions in the optimised plan, but for the names of columns: what the driver holds beside the schema."""
    n, todo = 0, [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        found = node.expressions()
        n += sum(found.apply(i).nodeName() != "AttributeReference" for i in range(found.size()))
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return n


def test_each_trap_costs_no_expression(spark, tmp_path):
    """Columns of the report are a schema, not expressions: at 60,000 traps
    one expression a trap, copied by each step, filled the driver."""
    from sitewise.plans import registry
    import __spark_entry__  # noqa: F401
    day, sizes = dt.datetime(2001, 2, 3), {}
    for n in (150, 300):
        lines = [(i * 7 % n, i % 13, 1.0 + i % 20, "N" if i % 5 == 0 else "A", i % 7, day) for i in range(1000)] + [(n + 5, 1, 2.0, "A", 1, day), (None, 1, 2.0, "A", 1, day), (1, None, 2.0, "A", 1, day)]
        d = str(tmp_path / str(n))
        spark.createDataFrame([(i, i % 25) for i in range(n)] + [(None, 3)], "s_suppkey long, s_nationkey int").write.parquet(d + "/supplier.parquet")
        spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double, l_returnflag string, l_linenumber int, l_shipdate timestamp").write.parquet(d + "/lineitem.parquet")
        df = registry.finished(registry.QUERIES["g13_species_by_each_trap"])(spark, d)
        assert df.columns == ["FIELDNAME", *sorted(f"trap_{i}" for i in range(n))] and set(dict(df.dtypes).values()) == {"string", "bigint"}
        want: dict = {}
        for s, p, _, flag, line, _ in lines:
            if s is not None and s < n:
                row = want.setdefault(f"Q{line % 5 + 1}" if flag == "N" else None if p is None else str(p), dict.fromkeys(range(n), 0))
                row[s] += 1
        got = [r.asDict() for r in df.collect()]
        assert len(got) == len(want)
        for r in got:
            assert {k: r[f"trap_{k}"] for k in range(n)} == want[r["FIELDNAME"]]
        sizes[n] = _expressions(df)
    assert sizes[150] == sizes[300] < 100


def test_slices_fill_and_odd_names(spark):
    from sitewise.operators.counts import species_by_trap_slices
    names = ["a b", "c`d", "e,f", '"g"', "ü"]
    df = spark.createDataFrame([(None, "c`d"), (None, "c`d"), ("x", "ü"), ("x", "?"), ("x", None), ("y", "?"), ('z,"1', "a b"), ('z,"1', '"g"')], "FIELDNAME string, TRAP string")
    want = {None: [0, 2, 0, 0, 0, 0], "x": [0, 0, 0, 0, 1, 2], "y": [0, 0, 0, 0, 0, 1], 'z,"1': [1, 0, 0, 1, 0, 0]}
    [w] = species_by_trap_slices(df, names, fill=0)
    assert w.columns == ["FIELDNAME", *names, "other"] and {r[0]: list(r[1:]) for r in w.collect()} == want
    [w] = species_by_trap_slices(df, names, fill=0, other=False)
    assert w.columns == ["FIELDNAME", *names] and {r[0]: list(r[1:]) for r in w.collect()} == {k: v[:-1] for k, v in want.items()}
    parts = species_by_trap_slices(df, names, 2)
    assert [p.columns[1:] for p in parts] == [names[:2], names[2:4], [names[4], "other"]]
    for i, p in enumerate(parts):
        assert {r[0]: list(r[1:]) for r in p.collect()} == {k: [x or None for x in v[2 * i:2 * i + 2]] for k, v in want.items()}
    [w] = species_by_trap_slices(df, [])
    assert {r[0]: r.other for r in w.collect()} == {None: 2, "x": 3, "y": 1, 'z,"1': 2}
