"""Aggregations by key.

All of them are plain ``groupBy``; Spark adds the map-side partial
aggregate, so only one row per key and task crosses the shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.functions._util import as_list, col
from sitewise.functions.dates import month_start
from sitewise.functions.nulls import r_max, r_mean, r_min, r_sum
from sitewise.operators._window import by_key, dealt


def daily_counts(df: DataFrame, keys, idx: str = "DATE", v: str = "VALUE",
                 out: str = "count", na_rm: bool = False) -> DataFrame:
    """Sum of the value by keys and day (G1, G2); null if a value is null
    unless ``na_rm``."""
    return df.groupBy(*as_list(keys), idx).agg(r_sum(v, na_rm).alias(out))


def daily_species(df: DataFrame, keys, idx: str = "DATE", v: str = "VALUE",
                  field: str = "FIELDNAME", out: str = "counts",
                  n_out: str = "n_species") -> DataFrame:
    """Daily total (nulls skipped, 0 when all are null) and the number of
    distinct field names, a null name counting as one more; 0 when the
    total is 0 (G3)."""
    f = col(field)
    total = r_sum(v, na_rm=True)
    n_names = F.count_distinct(f) + F.max(f.isNull().cast("int"))
    return (df.groupBy(*as_list(keys), idx)
            .agg(total.alias(out), n_names.alias("_n"))
            .withColumn(n_out, F.when(F.col(out) == 0, F.lit(0)).otherwise(F.col("_n")))
            .drop("_n"))


def daily_facts(df: DataFrame, keys, idx: str = "DATE", v: str = "VALUE",
                field: str = "FIELDNAME", taxon=None, out: str = "counts",
                n_out: str = "n_species") -> DataFrame:
    """One aggregate per key and day for the gap pipeline: whether any value
    of the day is null (all rows), and the taxon's daily total and species
    number (as ``daily_species`` on the taxon rows; ``has_taxon`` says
    whether the taxon was seen).  Missing days and taxon counts then come
    from the same aggregate, so the rows are scanned and shuffled once.
    """
    t = F.lit(True) if taxon is None else F.coalesce(taxon, F.lit(False))
    x, f = col(v), col(field)
    tx = F.when(t, x)
    agg = (df.groupBy(*as_list(keys), idx)
           .agg(F.bool_or(x.isNull()).alias("_anynull"),
                F.count_if(t).alias("_nt"),
                F.coalesce(F.sum(tx), F.lit(0.0)).alias(out),
                (F.count_distinct(F.when(t, f)) +
                 F.coalesce(F.max(F.when(t & f.isNull(), 1)), F.lit(0))).alias("_n")))
    return (agg.withColumn("has_taxon", F.col("_nt") > 0)
            .withColumn(n_out, F.when(F.col(out) == 0, F.lit(0)).otherwise(F.col("_n")))
            .drop("_nt", "_n"))


def monthly_totals(df: DataFrame, keys, idx: str = "DATE", v: str = "counts",
                   out_idx: str = "DATETIME") -> DataFrame:
    """Monthly sum (nulls skipped, 0 when none) and number of null days,
    dated the first of the month (G4)."""
    return (df.groupBy(*as_list(keys), month_start(idx).alias(out_idx))
            .agg(r_sum(v, na_rm=True).alias(v),
                 F.count_if(col(v).isNull()).alias("NA_per_mo")))


def monthly_mean(df: DataFrame, keys, idx: str = "DATE", v: str = "VALUE",
                 na_rm: bool = False, out: str | None = None,
                 out_idx: str | None = None) -> DataFrame:
    """Mean of a daily value by keys and month, dated the first."""
    out = out or v
    out_idx = out_idx or idx
    return (df.groupBy(*as_list(keys), month_start(idx).alias(out_idx))
            .agg(r_mean(v, na_rm).alias(out)))


def value_range(df: DataFrame, keys, v: str = "VALUE", lo: str = "min", hi: str = "max",
                na_rm: bool = False) -> DataFrame:
    """Min and max by key."""
    return df.groupBy(*as_list(keys)).agg(r_min(v, na_rm).alias(lo), r_max(v, na_rm).alias(hi))


def date_bounds(df: DataFrame, keys, idx: str = "DATE", lo: str = "date_min",
                hi: str = "date_max") -> DataFrame:
    """First and last date by key."""
    return df.groupBy(*as_list(keys)).agg(F.min(idx).alias(lo), F.max(idx).alias(hi))


def trap_columns(traps: DataFrame, trap: str = "TRAP", prefix: str = "") -> list:
    """The traps of a dimension table as a sorted list of column names: one
    short text a trap, the size of the report's header."""
    return sorted(prefix + str(r[0]) for r in traps.select(trap).where(F.col(trap).isNotNull()).distinct().collect())


def species_by_trap(df: DataFrame, traps: list, traits: DataFrame | None = None,
                    field: str = "FIELDNAME", trap: str = "TRAP",
                    code: str = "IM_CODE",
                    names=("Genus", "species", "COMMON_NAME", "Family")) -> DataFrame:
    """Number of rows per field name and trap, one column per trap, with the
    trait names beside (G13).  ``traps`` is the column list of the pivot:
    given, so that Spark needs no extra pass to find it.  Rows of other traps
    are counted in the column ``other`` (null if there are none)."""
    c = F.when(F.col(trap).isin(list(traps)), F.col(trap)).otherwise(F.lit("other"))
    wide = df.select(field, c.alias(trap)).groupBy(field).pivot(trap, [*traps, "other"]).count()
    if traits is None:
        return wide
    t = traits.select(F.col(code).alias(field), *names)
    return wide.join(t, field, "left")


def species_by_trap_slices(df: DataFrame, traps: list, width: int = 1000, traits: DataFrame | None = None,
                           field: str = "FIELDNAME", trap: str = "TRAP", fill: int | None = None,
                           other: bool = True, **kw) -> list[DataFrame]:
    """The same for thousands of traps, as tables of ``width`` trap columns
    each, in order; every slice has all field names, and a trap outside the
    whole list is counted in ``other`` of the last slice only (left out with
    ``other=False``).  A field without rows of a trap has ``fill`` there.  The
    rows are counted by field and trap first, one row each, and only those
    are turned: dealt by field, in the order of the columns, as one text a
    field that is read against the columns (``_turned``)."""
    traps = [str(t) for t in traps]
    places = df.sparkSession.createDataFrame(pa.table({"_t": pa.array(traps, pa.string()),
                                                       "_p": pa.array(range(len(traps)), pa.int32())}))
    long = df.groupBy(field, trap).agg(F.count("*").alias("_n"))
    long = dealt(long.join(places, F.col(trap).cast("string") == F.col("_t"), "left").select(field, "_p", "_n"), field)
    out = []
    for i in range(0, len(traps), width) if traps else [0]:
        part, last = traps[i:i + width], i + width >= len(traps)
        inside = F.col("_p").between(i, i + len(part) - 1)
        cells = long.groupBy(field).agg(
            F.sort_array(F.collect_list(F.when(inside, F.struct((F.col("_p") - i).alias("p"), F.col("_n").alias("n"))))).alias("_cells"),
            F.sum(F.when(F.col("_p").isNull(), F.col("_n"))).alias("_other"))
        wide = _turned(cells, part, field, fill, other and last)
        if traits is not None:
            t = traits.select(F.col(kw.get("code", "IM_CODE")).alias(field), *kw.get("names", ("Genus", "species", "COMMON_NAME", "Family")))
            wide = wide.join(t, field, "left")
        out.append(wide)
    return out


def _turned(cells: DataFrame, columns: list, field: str, fill: int | None, other: bool) -> DataFrame:
    """One row a field with a count column for each of ``columns``.  A pivot
    has an expression a column in its plan, several times over, which at
    60,000 columns fills the driver; here the columns are one schema that
    the whole row is read against, as comma-separated text."""
    head = [*columns, *(["other"] if other else [])]
    if not head:
        return cells.select(field)
    none = "-" if fill is None else str(int(fill))

    def blanks(n):
        return F.repeat(F.lit(none + ","), n)

    def cell(x, i):
        before = F.coalesce(F.get("_cells", i - 1)["p"], F.lit(-1))
        return F.concat(blanks(x["p"] - before - 1), x["n"].cast("string"), F.lit(","))

    end = F.coalesce(F.get("_cells", F.size("_cells") - 1)["p"], F.lit(-1))
    text = [F.array_join(F.transform("_cells", cell), ""), blanks(len(columns) - 1 - end)]
    if other:
        text.append(F.concat(F.coalesce(F.col("_other").cast("string"), F.lit(none)), F.lit(",")))
    row = F.rtrim(F.concat(*text), F.lit(","))
    schema = ", ".join("`" + c.replace("`", "``") + "` BIGINT" for c in head)
    options = {"mode": "FAILFAST", "nullValue": "-", "maxColumns": str(len(head) + 1)}
    return cells.select(field, F.inline(F.array(F.from_csv(row, F.lit(schema), options))))


def pivot_fields(df: DataFrame, keys, names: str, values: str, columns: list) -> DataFrame:
    """Long to wide: one column per field name (G14).  Keys plus name must be
    unique, as in the long weather table; of repeated ones the smallest value
    is taken.  ``n_other`` counts the rows of fields that are not listed."""
    ks = as_list(keys)
    listed = F.col(names).isin(list(columns))
    return df.groupBy(*ks).agg(*[F.min(F.when(F.col(names) == c, F.col(values))).alias(c) for c in columns],
                               F.count_if(~F.coalesce(listed, F.lit(False))).alias("n_other"))


def series_mean(df: DataFrame, keys, v: str, out: str = "level") -> DataFrame:
    """Overall level by key (G16): the fit of a constant."""
    return df.groupBy(*as_list(keys)).agg(F.avg(v).alias(out))


def zero_day_summary(df: DataFrame, keys, v: str = "counts") -> DataFrame:
    """Rows, zero days, non-zero days and null days by key."""
    c = col(v)
    return df.groupBy(*as_list(keys)).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count_if(c == 0).alias("n_zero"),
        F.count_if(c != 0).alias("n_nonzero"),
        F.count_if(c.isNull()).alias("n_null"))


def month_medians(df: DataFrame, keys, idx: str, v: str, na_rm: bool = False) -> DataFrame:
    """Median by calendar month and the mean of those medians."""
    ks = as_list(keys)
    med = (df.groupBy(*ks, F.month(idx).alias("month"))
           .agg(F.median(v).alias("median_month"),
                F.count(F.lit(1)).alias("_n"), F.count(v).alias("_nv")))
    if not na_rm:
        med = med.withColumn("median_month",
                             F.when(F.col("_n") == F.col("_nv"), F.col("median_month")))
    w = by_key(ks)
    return (med.drop("_n", "_nv")
            .withColumn("mean_of_medians", r_mean("median_month", w=w)))
