"""Connected components over edge tables, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the larger (or smaller) neighbours of each node to its smallest neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    own = least.where("a <> m").select("a", F.col("m").alias("b"))
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge; component is the smallest node reachable. Edges are (a, b), longs. `discard` drops what the result reads."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # Done when each node points once, and to one that points nowhere.
        points = edges.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
        pointed = edges.select(F.col("b").alias("to")).distinct()
        if not points.join(pointed, F.col("a") == F.col("to"), "left").where("lo <> hi or to is not null").limit(1).count():
            break
        before, edges = edges, written(_star(_star(edges, True), False), "edges")
        discard(before)
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = found.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    found._scratch = edges._scratch
    return found
