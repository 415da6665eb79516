"""Streams: row-wise operators work on streams as they are, as they are expressions; counts run as stateful aggregations. An extension of the batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def running_contingency(stream: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts of all rows so far (complete or update mode)."""
    return stream.groupBy(outer, inner).agg(F.count("*").alias("n"))


def windowed_statistics(stream: DataFrame, time: str, value: str, keys: Sequence[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """n, mean and deviation per window, finished once the watermark has passed it (append mode)."""
    w = F.window(time, window)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("dev")).select(F.col("w.start").alias("start"), *keys, "n", "mean", "dev")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what there is and stop."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path)
