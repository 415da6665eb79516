"""The folder that all machines share, and results kept there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir or setCheckpointDir names. Only a session on one machine, as in tests, may name none: it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        found = "file:///tmp/tarnwork-checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def pinned(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder: rows stay in the partitions that they have now, however often it is read."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
