"""Enrichment with dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich(df: DataFrame, groups: DataFrame | None = None, traits: DataFrame | None = None,
           field: str = "FIELDNAME", spec: str = "IM_SPEC", code: str = "IM_CODE",
           how: str = "left", value: str = "VALUE") -> DataFrame:
    """Attach functional group and traits to observation rows.

    ``how='left'`` keeps every row (J1).  ``how='inner'`` keeps rows whose
    field has a group, and drops rows without a value (J2: a right join to
    the groups followed by dropping null values is the same thing).

    No broadcast hint: the dimensions are joined on their key and the
    planner broadcasts them when their measured size is under the
    threshold; large ones are shuffled like any other side.
    """
    out = df
    if groups is not None:
        g = groups.withColumnRenamed(spec, "_spec")
        out = out.join(g, out[field] == g["_spec"], how).drop("_spec")
    if traits is not None:
        t = traits.withColumnRenamed(code, "_code")
        out = out.join(t, out[field] == t["_code"], "left").drop("_code")
    if how == "inner":
        out = out.filter(F.col(value).isNotNull())
    return out
