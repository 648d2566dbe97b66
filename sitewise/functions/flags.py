"""Quality flag rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A quality-flag field name contains the letter Q; the flag
# value itself is carried by the fields Q1, Q2, Q3, Q4 and Q5.
FLAG_LETTER = "Q"
FLAG_FIELD_PATTERN = "Q[1-5]"


def is_flag(field="FIELDNAME") -> Column:
    c = F.col(field) if isinstance(field, str) else field
    return c.contains(FLAG_LETTER)


def drop_flag_rows(df: DataFrame, field: str = "FIELDNAME") -> DataFrame:
    """Keep rows whose field name has no Q; a null name is dropped too."""
    return df.filter(~is_flag(field))


def with_flag_id(df: DataFrame, field: str = "FIELDNAME", value: str = "VALUE",
                 out: str = "FLAGID") -> DataFrame:
    """FLAGID = VALUE on flag rows Q1..Q5, null elsewhere."""
    return df.withColumn(out, F.when(F.col(field).rlike(FLAG_FIELD_PATTERN), F.col(value)))
