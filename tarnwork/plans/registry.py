"""Queries by name, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwork.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sql_uniform(seed: int, *keys: str) -> str:
    """`sampling.uniform` in SQL."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 13))::bigint / 4503599627370496.0::double)"


def sql_normal(seed: int, *keys: str) -> str:
    """`sampling.normal` in SQL."""
    return f"(sqrt(-2 * ln(1 - {sql_uniform(2 * seed, *keys)})) * cos(2 * pi() * {sql_uniform(2 * seed + 1, *keys)}))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoints(spark: SparkSession) -> None:
    """Iterative queries cut their lineage in the folder that the cluster names."""
    shared_dir(spark)
