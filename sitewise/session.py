"""Session helpers for local runs (tests, bench).

On a cluster the caller owns the session; nothing here overrides settings
that are already present, in particular ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "sitewise", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(LOCAL_CONF)
    mem = os.environ.get("SITEWISE_DRIVER_MEMORY")
    if mem:
        conf["spark.driver.memory"] = mem
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of the session: the one already set on
    the context, else the shared folder the cluster names in
    ``spark.checkpoint.dir``.  Without either a cluster is refused, as a
    folder of the driver's own machine would not be seen by the executors."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(d)
    return d


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A path under the session's checkpoint folder, for written tables that
    cut lineage (never a machine-local folder on a cluster)."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def cut_lineage(df, eager: bool = True):
    """Materialise ``df`` under the session's checkpoint folder and return a
    frame that reads it back, so a lost executor later recomputes from
    there, not from the raw scan.  A reliable checkpoint (``checkpoint``),
    never a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
