"""Sources and sinks.

Every reader uses a fixed schema: no inference pass over the data, and the
same column types whatever the file holds.  CSV is what the field data
arrive as; Parquet is what a pipeline should keep (a real DATE column lets
date filters reach the scan, which a filter on parsed text never can).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewise.functions.dates import parse_2digit_date, year_end
from sitewise.functions.flags import with_flag_id
from sitewise.functions.keys import station_key

OBS_SCHEMA = "SITECODE string, LCODE int, SDATE string, FIELDNAME string, VALUE double"
WEATHER_SCHEMA = "SITECODE string, DATE date, FIELDNAME string, daily double"
GROUPS_SCHEMA = "IM_SPEC string, IM_GROUP string, DESC_COMMON string, DESC_LATIN string"
TRAITS_SCHEMA = ("IM_CODE string, Genus string, species string, COMMON_NAME string, "
                 "Family string, WINGSPAN double")
ANNUAL_SCHEMA = "YEAR int, SITE string, DETERMINAND string, ANNUAL_AVG_ABUNDANCE double"
FORTNIGHTLY_SCHEMA = "DATE string, VARIABLE string, sign_if_LT_LOD string, VALUE double"

# Dataset name -> file name of the long observation file under
# the data root (S2); pass ``datasets=`` to read_observations for others.
DATASETS = {"moth": "ECN_IM1.csv", "butterfly": "ECN_IB1.csv"}


# Column of what a field file has wrong in a row, null if nothing.
PROBLEM = "_problem"
_RECORD = "_record"


def _read(spark: SparkSession, path: str, schema: str, fmt: str, problems: bool = False) -> DataFrame:
    """A file with a fixed schema; a field that is no value of its type is
    null.  With ``problems`` (text files) the column ``_problem`` names such
    fields with what they hold, and holds rows with too many or too few
    fields as they are: all columns are then read as text and cast, so that a
    problem does not depend on which columns a query uses."""
    if not problems or fmt != "csv":
        r = spark.read.schema(schema)
        if fmt == "csv":
            r = r.option("header", True).option("mode", "PERMISSIVE").option("nullValue", "NA")
        df = r.format(fmt).load(path)
        return df.withColumn(PROBLEM, F.lit(None).cast("string")) if problems else df
    fields = T.StructType.fromDDL(schema).fields
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields] + [T.StructField(_RECORD, T.StringType())])
    raw = (spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE").option("nullValue", "NA")
           .option("columnNameOfCorruptRecord", _RECORD).option("columnPruning", False).csv(path))
    typed, wrong = [], []
    for f in fields:
        c = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, T.StringType):
            value = F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})")
            wrong.append(F.when(c.isNotNull() & value.isNull(), F.concat(F.lit(f"{f.name}: "), c)))
            c = value
        typed.append(c.alias(f.name))
    wrong.append(F.when(F.col(_RECORD).isNotNull(), F.concat(F.lit("row: "), F.col(_RECORD))))
    return raw.select(*typed, F.nullif(F.concat_ws("; ", *wrong), F.lit("")).alias(PROBLEM))


def read_observations(spark: SparkSession, path: str | None = None, fmt: str = "csv",
                      dataset: str | None = None, root: str | None = None,
                      datasets: dict | None = None, problems: bool = False) -> DataFrame:
    """Long observation rows (S1); ``dataset`` picks the file by name.
    ``problems`` adds the column ``_problem`` (``malformed``)."""
    if dataset is not None:
        names = DATASETS if datasets is None else datasets
        if dataset not in names:
            raise ValueError(f"unknown dataset {dataset!r}; expected one of {sorted(names)}")
        if root is None:
            raise ValueError("root is needed with dataset")
        path = f"{root.rstrip('/')}/{names[dataset]}"
    if path is None:
        raise ValueError("path or dataset is needed")
    return _read(spark, path, OBS_SCHEMA, fmt, problems)


def clean_observations(obs: DataFrame, pivot: int = 69, keep_flags: bool = False,
                       sep: str = "-") -> DataFrame:
    """Parse the two-digit date, add the station key and the flag value,
    and (by default) drop the flag rows.  The text date is kept out.  A NaN
    value is null.  Rows without site, trap or a valid date belong to no
    series and are left out; ``rejected_observations`` returns them."""
    df = (obs
          .withColumn("VALUE", F.when(~F.isnan("VALUE"), F.col("VALUE")))
          .withColumn("DATE", parse_2digit_date("SDATE", pivot))
          .withColumn("station", station_key("SITECODE", "LCODE", sep)))
    df = with_flag_id(df).filter(~_rejected("DATE"))
    if not keep_flags:
        df = df.filter(~F.col("FIELDNAME").contains("Q"))
    return df.drop("SDATE")


def _rejected(date) -> F.Column:
    d = F.col(date) if isinstance(date, str) else date
    return F.col("SITECODE").isNull() | F.col("LCODE").isNull() | d.isNull()


def rejected_observations(obs: DataFrame, pivot: int = 69) -> DataFrame:
    """The rows ``clean_observations`` leaves out, as they came, with the
    reason.  Of a table read with ``problems``, also the malformed rows that
    it keeps with a null value (a sum over the day is then unknown, not too
    small)."""
    d = parse_2digit_date("SDATE", pivot)
    reason = (F.when(F.col("SITECODE").isNull(), F.lit("no site")).when(F.col("LCODE").isNull(), F.lit("no trap"))
              .when(d.isNull(), F.lit("bad date")).otherwise(F.lit("malformed")))
    bad = _rejected(d) | F.col(PROBLEM).isNotNull() if PROBLEM in obs.columns else _rejected(d)
    return obs.filter(bad).withColumn("reason", reason)


def malformed(df: DataFrame) -> DataFrame:
    """Rows of a table read with ``problems`` that have one."""
    return df.filter(F.col(PROBLEM).isNotNull())


def read_dimension(spark: SparkSession, path: str, schema: str = GROUPS_SCHEMA,
                   fmt: str = "csv", problems: bool = False) -> DataFrame:
    """A small text table with an explicit schema (S3).  Joins against it are
    left to the planner: it broadcasts the side whose measured size is under
    ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at run time)."""
    return _read(spark, path, schema, fmt, problems)


def read_weather(spark: SparkSession, path: str, fmt: str = "parquet", problems: bool = False) -> DataFrame:
    """Daily weather in long form."""
    return _read(spark, path, WEATHER_SCHEMA, fmt, problems)


def trim_trait_code(df: DataFrame, code: str = "IM_CODE", cut: int = 3) -> DataFrame:
    """Drop the fixed prefix of the trait code, so it matches FIELDNAME."""
    return df.withColumn(code, F.expr(f"substr(`{code}`, {cut + 1})"))


def read_traits(spark: SparkSession, path: str, fmt: str = "csv", problems: bool = False) -> DataFrame:
    return trim_trait_code(_read(spark, path, TRAITS_SCHEMA, fmt, problems))


def read_annual_series(spark: SparkSession, path: str, site: str | None = None,
                       determinand: str | None = None, start=None, end=None, problems: bool = False) -> DataFrame:
    """Annual site series (S6): dated 31 December, filtered, windowed.  With
    ``problems``, rows whose year is malformed stay, without a date."""
    df = _read(spark, path, ANNUAL_SCHEMA, "csv", problems)
    if site is not None:
        df = df.filter(F.col("SITE") == site)
    if determinand is not None:
        df = df.filter(F.col("DETERMINAND") == determinand)
    df = df.select(year_end("YEAR").alias("DATETIME"), "ANNUAL_AVG_ABUNDANCE", *[c for c in [PROBLEM] if problems])
    return _window(df, "DATETIME", start, end, problems)


def read_fortnightly_series(spark: SparkSession, path: str, variable: str | None = None,
                            start=None, end=None, pivot: int = 21, problems: bool = False) -> DataFrame:
    """Fortnightly series with ``dd-Mon-yy`` dates, century pivot 21.
    With ``problems``, rows without a valid date stay, and it is named."""
    df = _read(spark, path, FORTNIGHTLY_SCHEMA, "csv", problems)
    if variable is not None:
        df = df.filter(F.col("VARIABLE") == variable)
    at = parse_2digit_date("DATE", pivot)
    named = F.when(at.isNull(), F.concat(F.lit("DATE: "), F.coalesce("DATE", F.lit("NA"))))
    extra = [F.nullif(F.concat_ws("; ", named, F.col(PROBLEM)), F.lit("")).alias(PROBLEM)] if problems else []
    df = df.select(at.alias("DATETIME"), "VALUE", *extra)
    return _window(df, "DATETIME", start, end, problems)


def _window(df: DataFrame, idx: str, start, end, problems: bool = False) -> DataFrame:
    undated = F.col(idx).isNull() if problems else F.lit(False)
    if start is not None:
        df = df.filter((F.col(idx) >= F.lit(start).cast("date")) | undated)
    if end is not None:
        df = df.filter((F.col(idx) <= F.lit(end).cast("date")) | undated)
    return df


def write_report(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite",
                 partition_by: list[str] | None = None) -> None:
    """Write a result (S7).  CSV gets a header; Parquet is the default for
    anything read again."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_ordered(df: DataFrame, path: str, order: list, fmt: str = "csv", mode: str = "overwrite") -> None:
    """A report in order (O1): a sort over range partitions, so that the part
    files by name, one behind the other, are the rows in ``order``.  CSV parts
    have no header line, as it would stand in the middle of the report."""
    w = df.orderBy(*order).write.mode(mode).format(fmt)
    (w.option("header", False) if fmt == "csv" else w).save(path)


def read_ordered(spark: SparkSession, path: str, schema: str, fmt: str = "csv", line: str = "line") -> DataFrame:
    """The rows of ``write_ordered`` with their place in the report (from 1):
    the rows of the files before, one number a file, and the place within the
    file, by block and row."""
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    rows = spark.read.schema(schema).format(fmt).load(path).select(
        *names, F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"))
    before, total = [], 0
    for r in rows.groupBy("_f").agg(F.count("*").alias("n")).orderBy("_f").collect():  # one row a part file
        before += [F.lit(r._f), F.lit(total)]
        total += r.n
    if not before:
        return rows.select(*names, F.lit(None).cast("long").alias(line))
    at = F.create_map(*before)[F.col("_f")] + F.row_number().over(Window.partitionBy("_f").orderBy("_b", "_m"))
    return rows.select(*names, at.cast("long").alias(line))
