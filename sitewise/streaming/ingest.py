"""Observation files arrive over time (one file per collection round).

``read_observation_stream`` reads a folder as a stream with the fixed
observation schema and applies the same cleaning as the batch reader;
``start_clean_ingest`` writes it to Parquet (a real DATE column, partitioned
by site) so that every batch operator reads it with pushed-down filters;
``stream_daily_counts`` keeps daily counts per station up to date, a day
being final once the watermark passes it.

Checkpoints go under the session's ``spark.checkpoint.dir`` (a shared folder
on a cluster), so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitewise.sources.readers import OBS_SCHEMA, clean_observations
from sitewise.session import checkpoint_path


def read_observation_stream(spark: SparkSession, src_dir: str, fmt: str = "csv",
                            max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(OBS_SCHEMA).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return clean_observations(r.load(src_dir))


def start_clean_ingest(spark: SparkSession, src_dir: str, out_dir: str, name: str = "obs_ingest",
                       fmt: str = "csv", available_now: bool = True) -> StreamingQuery:
    df = read_observation_stream(spark, src_dir, fmt)
    w = (df.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint_path(spark, f"{name}/checkpoint"))
         .partitionBy("SITECODE"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(out_dir)


def stream_daily_counts(clean_stream: DataFrame, keys=("SITECODE", "station"),
                        lateness: str = "14 days") -> DataFrame:
    """Daily count per station from a stream (G1).  Rows may arrive up to
    ``lateness`` after their day; a day is emitted once, when final.  As in
    the batch count, a day with a null value is null; the number of nulls is
    given beside it."""
    ts = F.col("DATE").cast("timestamp")
    return (clean_stream.withColumn("_ts", ts).withWatermark("_ts", lateness)
            .groupBy(*keys, F.window("_ts", "1 day").alias("day"))
            .agg(F.when(F.count_if(F.col("VALUE").isNull()) == 0, F.sum("VALUE")).alias("count"),
                 F.count_if(F.col("VALUE").isNull()).alias("n_null"))
            .select(*keys, F.to_date(F.col("day.start")).alias("DATE"), "count", "n_null"))
