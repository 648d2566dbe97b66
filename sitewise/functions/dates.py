"""Date parsing and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions._util import col


def parse_2digit_date(c, pivot: int = 69, fmt: str = "d-MMM-yy") -> Column:
    """Text like ``05-Jan-93`` to a DATE with an explicit century pivot.

    Two-digit years ``>= pivot`` belong to the 1900s, the rest to the 2000s
    (pivot 69 is the usual C-library rule, pivot 21 the phosphate loader's).
    The century is put in front of the last two characters, and the text is
    parsed once.  Bad text gives null, never an error (``try_to_date``), as
    does a 29 February of a year that has none.
    """
    text = F.trim(col(c))
    yy = F.right(text, F.lit(2))
    century = F.when(yy >= f"{pivot:02d}", F.lit("19")).otherwise(F.lit("20"))
    head = F.left(text, F.length(text) - 2)
    return F.try_to_date(F.concat(head, century, yy), fmt.replace("yy", "yyyy"))


def year_end(year) -> Column:
    """Year number to 31 December of that year."""
    return F.make_date(col(year), F.lit(12), F.lit(31))


def month_start(d) -> Column:
    """First day of the month (year-month key, P14/P15)."""
    return F.trunc(col(d), "month")


def month_end(d) -> Column:
    """Last day of the month."""
    return F.last_day(col(d))


def days_in_month(d) -> Column:
    return F.dayofmonth(F.last_day(col(d)))


def with_calendar_parts(df: DataFrame, idx: str = "DATE", prefix: str = "") -> DataFrame:
    """Add year, month, month name and days in month."""
    d = col(idx)
    return df.withColumns({
        f"{prefix}year": F.year(d),
        f"{prefix}month": F.month(d),
        f"{prefix}monthname": F.date_format(d, "MMMM"),
        f"{prefix}days_in_month": days_in_month(d),
    })
