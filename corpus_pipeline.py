"""From raw documents to token ids: toxicity, line dedup, n-gram Jaccard join, decontamination, BPE.

Each stage takes (spark, documents, folder of the tables) and works on every row that the stage before it kept; all but the last return the columns
of documents. `run` applies them in order, each written as Parquet in the shared folder and read again.

Defined results: a null or empty text is no ground to drop a row; rows of a null id are told apart by their texts; an empty table gives
an empty one; other columns of the table pass through, whatever their names. Of rows of one id and text each stage but the third keeps all or none,
the third keeps one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm import bpe, decontaminate, jaccard, lines, toxicity
from tarnwork.llm.common import discard, scratch_path, text_key, unused
from tarnwork.llm.queries import table, tokenizer_path


def row_of(doc_id: str, key: Column) -> Column:
    """What tells documents apart: id (null is an id of its own) and text."""
    return F.struct(F.col(doc_id).isNull().alias("unknown"), F.coalesce(doc_id, F.lit(0)).cast("long").alias("no"), key.alias("key"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain's last model gives less than an even chance of toxicity, or no chance at all for want of labels."""
    links = toxicity.train(docs, table(spark, sf_dir, "labels"), ["quality", "toxic"])
    names = [unused(docs, "_quality"), unused(docs, "_toxic")]
    scored = toxicity.score(docs, links, names)
    return scored.where(F.col(names[1]).isNull() | (F.col(names[1]) < 0.5)).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are (nearly) in an earlier one; a document of which nothing is left goes. n_chars follows the text."""
    away = {c: unused(docs, f"{c}_own") for c in ("_n_lines", "_n_removed") if c in docs.columns}
    found = lines.dedup_lines(docs.withColumnsRenamed(away))
    found = found.where((F.col("_n_removed") == 0) | (F.length(F.trim(F.regexp_replace("text", r"\s", ""))) > 0))
    return found.select(*(F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(away.get(c, c)).alias(c) for c in docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that of the smallest id; of documents without words, one of each id and text."""
    row = unused(docs, "_row")
    found = jaccard.join(docs).where("first").select(row_of("doc_id", F.col("key")).alias(row))
    return docs.withColumn(row, row_of("doc_id", text_key("text"))).join(found, row, "left_semi").dropDuplicates([row]).drop(row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    row = unused(docs, "_row")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(row_of("doc_id", F.col("key")).alias(row)).distinct()
    return docs.withColumn(row, row_of("doc_id", text_key("text"))).join(found, row, "left_anti").drop(row)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and what those decode to."""
    return bpe.encode(docs, tokenizer_path(), decoded_col="decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", tokenize),
]

#: The classifier and the near-duplicate stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{k}-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        docs._scratch = path
        discard(last)
        last = docs
    return docs
