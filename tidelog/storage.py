"""The folder that the driver and all executors see, and tables written there to end a lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode where the session names no folder, as in tests.
OWN_FOLDER = "file:///tmp/checkpoints/tidelog"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode our own where that is unset; on a cluster it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    return (named or OWN_FOLDER).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the JVM ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: Has the engine delete an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage ends there and survives lost executors.

    What was shuffled for it isn't needed any more and goes at once; the session's setting is as before.
    """
    path, conf = new_path(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # a plan of its own, as the setting is taken when a plan is made
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df._written_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
