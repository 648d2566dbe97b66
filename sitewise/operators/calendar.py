"""Calendar completion.

Completion is a single pass per key (``gap_fill``): the next date of each
row comes from ``lead`` over the key's window, and the missing periods up to
it are emitted with ``posexplode``.  Nothing is joined back, so the data is
read once and stays hash-partitioned by its keys for every later window.
The output has one row per key and period: it grows with the number of
series and their span, not with the raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions._util import as_list, col
from sitewise.functions.dates import month_start
from sitewise.functions.nulls import r_median
from sitewise.operators._window import ahead, by_key, running


def _step(unit: str) -> Column:
    return F.expr(f"INTERVAL 1 {unit}")


def _lit_date(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("date")


def bounds(df: DataFrame, keys, idx: str, lo=None, hi=None, to_month: bool = False) -> DataFrame:
    """Per key first and last date, optionally clipped to [lo, hi]."""
    d = month_start(idx) if to_month else col(idx)
    b = df.groupBy(*as_list(keys)).agg(F.min(d).alias("_lo"), F.max(d).alias("_hi"))
    if lo is not None:
        b = b.withColumn("_lo", F.greatest("_lo", _lit_date(lo)))
    if hi is not None:
        b = b.withColumn("_hi", F.least("_hi", _lit_date(hi)))
    return b.filter(F.col("_lo") <= F.col("_hi"))


def day_calendar(df: DataFrame, keys, idx: str = "DATE", lo=None, hi=None) -> DataFrame:
    """Every day between each key's first and last date (one row per key
    and day), from the key's bounds."""
    ks = as_list(keys)
    return (bounds(df, ks, idx, lo, hi)
            .select(*ks, F.explode(F.sequence("_lo", "_hi", _step("DAY"))).alias(idx)))


FILLED = "_filled"


def gap_fill(df: DataFrame, keys, idx: str, unit: str = "day", anchor: str = "start",
             flag: str | None = None) -> DataFrame:
    """The rows of ``df`` plus one row for every day (or month) missing
    between consecutive rows of the same key; new rows have null values.

    One pass: ``lead(idx)`` over the key's window gives the next date, and
    ``posexplode`` of the dates up to it emits the row itself (position 0)
    and the missing periods.  No calendar is joined back to the data, so
    the data is neither scanned twice nor shuffled on (key, date); the
    result keeps the key partitioning of the window.  Several rows on one
    date (or in one month) are all kept, with no filler between them.
    Months: ``idx`` holds month starts (``anchor='start'``) or month ends
    (``'end'``); other days of a month are kept as they are.
    """
    ks = as_list(keys)
    d = col(idx)
    nxt = F.lead(d).over(by_key(ks, idx))
    if unit == "day":
        last = F.date_sub("_next", 1)
        seq = F.when(F.col("_next").isNotNull() & (last > d), F.sequence(d, last, _step("DAY")))
    elif unit == "month":
        s0, last = F.trunc(d, "month"), F.add_months(F.trunc("_next", "month"), -1)
        seq = F.when(F.col("_next").isNotNull() & (last > s0), F.sequence(s0, last, _step("MONTH")))
        if anchor == "end":
            seq = F.transform(seq, lambda x: F.last_day(x))
        elif anchor != "start":
            raise ValueError("anchor is 'start' or 'end'")
    else:
        raise ValueError("unit is 'day' or 'month'")
    other = [c for c in df.columns if c not in ks and c != idx]
    g = (df.withColumn("_next", nxt)
         .select(*ks, idx, *other, F.posexplode(F.coalesce(seq, F.array(d))).alias("_pos", "_d")))
    first = F.col("_pos") == 0
    out = g.select(*ks, F.when(first, d).otherwise(F.col("_d")).alias(idx),
                   *[F.when(first, F.col(c)).alias(c) for c in other],
                   (~first).alias(flag or FILLED))
    return out if flag else out.drop(FILLED)


def complete_days(df: DataFrame, keys, idx: str = "DATE", lo=None, hi=None,
                  fill: dict | None = None) -> DataFrame:
    """Every day between a key's first and last row (C1); rows outside
    [lo, hi] are left out first.  Days without data have nulls (or
    ``fill``)."""
    from sitewise.operators.filters import between_dates
    out = gap_fill(between_dates(df, idx, lo, hi), keys, idx, "day")
    return out.fillna(fill) if fill else out


def complete_months(df: DataFrame, keys, idx: str = "DATE", fill: dict | None = None,
                    anchor: str = "start") -> DataFrame:
    """Every month of each key (C2, C3).  ``idx`` must hold month starts
    (``anchor='start'``) or month ends (``'end'``)."""
    out = gap_fill(df, keys, idx, "month", anchor)
    return out.fillna(fill) if fill else out


def missing_months(df: DataFrame, keys, idx: str = "DATE", anchor: str = "start") -> DataFrame:
    """Calendar months of a key with no row in the data."""
    ks = as_list(keys)
    g = gap_fill(df.select(*ks, idx), ks, idx, "month", anchor, flag="_m")
    return g.filter(F.col("_m")).drop("_m")


def all_dates_present(df: DataFrame, keys, idx: str = "DATE", anchor: str = "start") -> DataFrame:
    """Per key: months in the calendar, months missing, and whether all are
    present (J10)."""
    ks = as_list(keys)
    g = gap_fill(df.select(*ks, idx), ks, idx, "month", anchor, flag="_m")
    return (g.groupBy(*ks).agg(F.count_distinct(F.trunc(idx, "month")).alias("n_months"),
                               F.count_if(F.col("_m")).alias("n_missing"))
            .withColumn("all_present", F.col("n_missing") == 0))


def fill_month_median(df: DataFrame, keys, idx: str = "DATE", v: str = "value",
                      missing: str = "missing") -> DataFrame:
    """Complete the months; a missing or null value takes the median of the
    same calendar month of that key (nulls skipped), flagged in
    ``missing`` (C4)."""
    ks = as_list(keys)
    full = complete_months(df, ks, idx).withColumn("month", F.month(idx))
    med = r_median(v, na_rm=True, w=by_key(ks + ["month"]))
    return (full.withColumn(missing, col(v).isNull())
            .withColumn(v, F.coalesce(col(v), med)))


def interpolate_linear(df: DataFrame, keys, idx: str = "date", v: str = "value",
                       missing: str = "missing", anchor: str = "end") -> DataFrame:
    """Complete the months and fill each missing value on the straight line
    through the nearest non-null months before and after it, on the day
    axis (C5).  Without a neighbour on both sides the value stays null.

    Constant per-series columns (site, value type) belong in ``keys`` so that
    new months carry them.
    """
    ks = as_list(keys)
    full = complete_months(df, ks, idx, anchor=anchor)
    x = col(v)
    seen_d = F.when(x.isNotNull(), col(idx))
    back, fwd = running(ks, idx), ahead(ks, idx)
    d0 = F.last(seen_d, ignorenulls=True).over(back)
    y0 = F.last(x, ignorenulls=True).over(back)
    d1 = F.last(seen_d, ignorenulls=True).over(fwd)
    y1 = F.last(x, ignorenulls=True).over(fwd)
    line = y0 + (y1 - y0) * F.datediff(col(idx), d0) / F.datediff(d1, d0)
    return (full.withColumn(missing, x.isNull())
            .withColumn(v, F.when(x.isNull(), line).otherwise(x)))
