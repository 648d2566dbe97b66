"""Aggregates with explicit null rules.

Spark aggregates skip nulls.  Field scripts often want the opposite: a total
or mean is unknown as soon as one input is unknown.  Each helper takes
``na_rm``: ``False`` gives null when any input in the group is null,
``True`` skips nulls (and a sum over no values is 0).  Pass ``w`` to use the
same rule as a window aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from sitewise.functions._util import col


def _over(e: Column, w: WindowSpec | None) -> Column:
    return e.over(w) if w is not None else e


def all_present(v, w: WindowSpec | None = None) -> Column:
    """True when no value of the group (or window frame) is null."""
    c = col(v)
    return _over(F.count(c), w) == _over(F.count(F.lit(1)), w)


def _strict(agg: Column, v, na_rm: bool, w: WindowSpec | None) -> Column:
    a = _over(agg, w)
    return a if na_rm else F.when(all_present(v, w), a)


def r_sum(v, na_rm: bool = False, w: WindowSpec | None = None) -> Column:
    s = _strict(F.sum(col(v)), v, na_rm, w)
    return F.coalesce(s, F.lit(0)) if na_rm else s


def r_mean(v, na_rm: bool = False, w: WindowSpec | None = None) -> Column:
    return _strict(F.avg(col(v)), v, na_rm, w)


def r_median(v, na_rm: bool = False, w: WindowSpec | None = None) -> Column:
    return _strict(F.median(col(v)), v, na_rm, w)


def r_sd(v, na_rm: bool = False, w: WindowSpec | None = None) -> Column:
    """Sample standard deviation; one value gives null."""
    return _strict(F.stddev_samp(col(v)), v, na_rm, w)


def r_min(v, na_rm: bool = False, w: WindowSpec | None = None) -> Column:
    return _strict(F.min(col(v)), v, na_rm, w)


def r_max(v, na_rm: bool = False, w: WindowSpec | None = None) -> Column:
    return _strict(F.max(col(v)), v, na_rm, w)
