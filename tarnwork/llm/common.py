"""What the training-data operators share: scratch tables, word splitting on bytes, shingle hashes."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.session import shared_dir

#: Rows handled at a time inside one Arrow batch, so that intermediate lists stay small.
SLICE_ROWS = 512


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tarnwork/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder (with these options of the format) and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete what `written` wrote for these tables, once nothing that is still to run reads them."""
    for table in tables:
        if table is not None and getattr(table, "_scratch", None):
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            table._scratch = None


def unused(df: DataFrame, name: str) -> str:
    """`name`, or a longer one if the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_key(text: str | Column) -> Column:
    """With the document id, tells rows of one id apart by their text (null is a text of its own)."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("\x00null")))


def placed(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """`df` with each row's place (from 0) in its group, in that order; `group` holds no nulls. `discard` drops what the result reads.

    No window runs over a group: rows are range-partitioned by group and order (rows alike in these are dealt on by where they were read), written
    in that order with a running number, and a row per partition and group says where the group begins there.
    """
    keys = [F.col(group), *order, F.col("_read")]
    sorted_ = df.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read")
    rows = written(sorted_.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), name)
    begins = rows.groupBy("_part", group).agg(F.min("_at").alias("_begin"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = begins.select("_part", group, (F.coalesce(before, F.lit(0)) - F.col("_begin")).alias("_shift"))
    out = rows.join(begins, ["_part", group]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
    out._scratch = rows._scratch
    return out


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of a piece have about `most` bytes."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def crcs(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k words, in order; sizes differ in their hashes."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mix(h * _ODD + word_hashes[i : i + n])
    return h
