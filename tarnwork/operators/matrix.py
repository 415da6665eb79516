"""Symmetric matrices as tables (i, j, d), i > j."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def both_sides(matrix: DataFrame) -> DataFrame:
    return matrix.select("i", "j", "d").unionByName(matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def nearest(matrix: DataFrame, k: int) -> DataFrame:
    """(i, j, d, rank): the k nearest of each element, the lower of equals first."""
    by = Window.partitionBy("i").orderBy("d", "j")
    return both_sides(matrix).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def inverted(matrix: DataFrame, how: str = "1-x") -> DataFrame:
    """Distances as similarities, or the other way: -x, 1-x, max-x, or 1/x."""
    d = F.col("d")
    if how == "max-x":
        return matrix.join(F.broadcast(matrix.agg(F.max("d").alias("_m")))).select("i", "j", (F.col("_m") - d).alias("d"))
    return matrix.select("i", "j", {"-x": -d, "1-x": 1 - d, "1/x": F.try_divide(F.lit(1.0), d)}[how].alias("d"))


def normalized(matrix: DataFrame, how: str = "span") -> DataFrame:
    """To [0, 1] by the span of values, or by the logistic function."""
    if how == "sigmoid":
        return matrix.select("i", "j", (1 / (1 + F.exp(-F.col("d")))).alias("d"))
    span = matrix.agg(F.min("d").alias("_lo"), F.max("d").alias("_hi"))
    return matrix.join(F.broadcast(span)).select("i", "j", F.coalesce(F.try_divide(F.col("d") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)).alias("d"))


def combined(a: DataFrame, b: DataFrame, how: str = "mean") -> DataFrame:
    """Cell by cell: sum, mean, min, max or product of two matrices of the same elements."""
    x, y = F.col("x"), F.col("y")
    value: dict[str, Column] = {"sum": x + y, "mean": (x + y) / 2, "min": F.least(x, y), "max": F.greatest(x, y), "product": x * y}
    return a.withColumnRenamed("d", "x").join(b.withColumnRenamed("d", "y"), ["i", "j"]).select("i", "j", value[how].alias("d"))


def of_elements(matrix: DataFrame, wanted: DataFrame) -> DataFrame:
    """The part of the elements in `wanted` (id)."""
    return matrix.join(wanted.select(F.col("id").alias("i")), "i", "left_semi").join(wanted.select(F.col("id").alias("j")), "j", "left_semi").select("i", "j", "d")


def average_link(matrix: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, d): the mean distance between each two groups' elements. groups: (id, group)."""
    left, right = groups.select(F.col("id").alias("i"), F.col("group").alias("a")), groups.select(F.col("id").alias("j"), F.col("group").alias("b"))
    return both_sides(matrix).join(left, "i").join(right, "j").where("a > b").groupBy("a", "b").agg(F.avg("d").alias("d"))


def distance_map(matrix: DataFrame, places: DataFrame, cell: int) -> DataFrame:
    """(y, x, d): the matrix in another order, squeezed to squares of `cell` elements that have their mean. places: (id, place)."""
    both = both_sides(matrix).join(places.select(F.col("id").alias("i"), F.col("place").alias("p")), "i").join(places.select(F.col("id").alias("j"), F.col("place").alias("q")), "j")
    return both.groupBy(F.floor(F.col("p") / cell).alias("y"), F.floor(F.col("q") / cell).alias("x")).agg(F.avg("d").alias("d"))
