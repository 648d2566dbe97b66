"""Stand-in inputs built from the driver's tables.

The field files (observations, weather, groups, traits) are not available;
the driver's star-schema tables play their roles, with the same mapping on
the Spark side and in the SQL oracle:

* observations = lineitem joined to supplier: site ``T<nation, 2 digits>``,
  trap code = supplier key, text date ``dd-Mon-yy`` of the ship date, field
  = part key as text, value = quantity with 13 made null; rows with return
  flag N stand for the quality-flag rows (field ``Q1``..``Q5``).
* groups and traits = part: group = p_type, common name = p_name,
  genus = p_brand, wingspan = p_size.
* weather = orders joined to customer: site from the customer's nation,
  field = order priority, daily value = mean total price of that day.
* site list for membership filters = the nations of one region.

None of these joins carries a broadcast hint: supplier, part and customer
grow with the data, so the planner decides from measured sizes (AQE).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def site_code(nationkey) -> F.Column:
    c = F.col(nationkey) if isinstance(nationkey, str) else nationkey
    return F.concat(F.lit("T"), F.lpad(c.cast("string"), 2, "0"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_partkey", "l_quantity", "l_returnflag", "l_linenumber", "l_shipdate")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    flag_name = F.concat(F.lit("Q"), ((F.col("l_linenumber") % 5) + 1).cast("string"))
    return (li.join(su, li.l_suppkey == su.s_suppkey)
            .select(site_code("s_nationkey").alias("SITECODE"),
                    F.col("l_suppkey").alias("LCODE"),
                    F.date_format("l_shipdate", "dd-MMM-yy").alias("SDATE"),
                    F.when(F.col("l_returnflag") == "N", flag_name)
                     .otherwise(F.col("l_partkey").cast("string")).alias("FIELDNAME"),
                    F.nullif(F.col("l_quantity"), F.lit(13.0)).alias("VALUE")))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("IM_SPEC"),
        F.col("p_type").alias("IM_GROUP"),
        F.col("p_name").alias("DESC_COMMON"),
        F.col("p_brand").alias("DESC_LATIN"))


def raw_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traits as they arrive: the code still carries its 3-character prefix."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("IM_"), F.col("p_partkey").cast("string")).alias("IM_CODE"),
        F.col("p_brand").alias("Genus"),
        F.col("p_name").alias("species"),
        F.col("p_name").alias("COMMON_NAME"),
        F.col("p_type").alias("Family"),
        F.col("p_size").cast("double").alias("WINGSPAN"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority",
                                              "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .groupBy(site_code("c_nationkey").alias("SITECODE"),
                     F.col("o_orderdate").cast("date").alias("DATE"),
                     F.col("o_orderpriority").alias("FIELDNAME"))
            .agg(F.avg("o_totalprice").alias("daily")))


def region_sites(spark: SparkSession, sf_dir: str, region: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region").filter(F.col("r_name") == region)
    return (n.join(r, n.n_regionkey == r.r_regionkey, "left_semi")
            .select(site_code("n_nationkey").alias("SITECODE")))
