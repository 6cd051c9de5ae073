"""Session settings that the queries are designed for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC, and Arrow; further settings by keyword with ``__`` for dots."""
    b = SparkSession.builder.appName("panelcast")
    if master:
        b = b.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where that is unset in a local session, a temporary one."""
    if conf := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not hasattr(spark, "_panelcast_shared"):
        spark._panelcast_shared = "file://" + tempfile.mkdtemp(prefix="panelcast-")
    return spark._panelcast_shared


def kept(df: DataFrame) -> DataFrame:
    """df computed once and read from the shared folder from here on: what reads it several times neither computes nor plans it again, and a lost executor
    costs no earlier stage. Spark removes the files with the frame where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
