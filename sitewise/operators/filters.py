"""Row filters."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions._util import col


def between_dates(df: DataFrame, idx: str = "DATE", lo=None, hi=None) -> DataFrame:
    """Inclusive date window (P8); a bound of None is open.  On a DATE
    column read from Parquet the bounds reach the scan as pushed filters."""
    if lo is not None:
        df = df.filter(col(idx) >= F.lit(lo).cast("date"))
    if hi is not None:
        df = df.filter(col(idx) <= F.lit(hi).cast("date"))
    return df


def filter_in(df: DataFrame, column: str, values) -> DataFrame:
    """Membership filter (P9).  A Python list becomes ``isin`` (pushed to
    the scan); a DataFrame with that column becomes a left semi join (which
    ignores repeated values, so no ``distinct`` shuffle first); the planner
    broadcasts it only when its measured size allows."""
    if isinstance(values, DataFrame):
        return df.join(values.select(column), column, "left_semi")
    return df.filter(col(column).isin(list(values)))


# The functional group letters of the moth groups table.
GROUP_LETTERS = ("G", "M", "N", "O")


@dataclass(frozen=True)
class Taxa:
    """What to keep (P10).  Exactly one of the fields, or none for all rows.

    ``common_name``: a species by its common name; ``group``: a functional
    group; ``where``: a predicate on the enriched rows, as a ``Column`` or a
    Spark SQL string (``"WINGSPAN > 40 AND Genus = 'Agrotis'"``).
    """
    common_name: str | None = None
    group: str | None = None
    where: object = None


def resolve_taxa(spec, common_names=(), groups=GROUP_LETTERS) -> Taxa:
    """Three-way dispatch of a single text spec, resolved in Python before
    the plan is built: a known common name, a group letter, plain words (a
    common name too), else a predicate; None keeps all rows."""
    if spec is None or isinstance(spec, Taxa):
        return spec or Taxa()
    if isinstance(spec, Column):
        return Taxa(where=spec)
    if spec in set(common_names):
        return Taxa(common_name=spec)
    if spec in set(groups):
        return Taxa(group=spec)
    # a predicate needs a comparison, a bracket or a keyword between operands
    if not re.search(r"[=<>()!]|\b(and|or|not|in|like|rlike|between|is)\b", spec, re.I):
        return Taxa(common_name=spec)
    return Taxa(where=spec)


def select_taxa(df: DataFrame, spec, common_col: str = "DESC_COMMON",
                group_col: str = "IM_GROUP", **kw) -> DataFrame:
    t = resolve_taxa(spec, **kw)
    if t.common_name is not None:
        return df.filter(F.col(common_col) == t.common_name)
    if t.group is not None:
        return df.filter(F.col(group_col) == t.group)
    if t.where is not None:
        return df.filter(t.where if isinstance(t.where, Column) else F.expr(t.where))
    return df


def taxa_predicate(spec, common_col: str = "DESC_COMMON", group_col: str = "IM_GROUP", **kw) -> Column:
    """The row predicate of a taxon spec (True for every row when None)."""
    t = resolve_taxa(spec, **kw)
    if t.common_name is not None:
        return F.col(common_col) == t.common_name
    if t.group is not None:
        return F.col(group_col) == t.group
    if t.where is not None:
        return t.where if isinstance(t.where, Column) else F.expr(t.where)
    return F.lit(True)
