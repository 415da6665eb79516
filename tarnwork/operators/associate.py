"""Itemsets and association rules over baskets (array columns) or discrete columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.session import pinned


def items_of(df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """(key, item), item is attribute=value of each known discrete value."""
    long = df.select(key, *(F.col(c).cast("string").alias(c) for c in names)).unpivot(key, list(names), "a", "v").where("v is not null")
    return long.select(F.col(key).alias("key"), F.concat_ws("=", "a", "v").alias("item"))


def _frequent(items: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    total = pinned(items.agg(F.count_distinct("key").alias("n")))
    one = items.distinct().groupBy("item").agg(F.count("*").alias("c")).join(F.broadcast(total)).where(F.col("c") >= least * F.col("n"))
    return one, total


def itemsets(items: DataFrame, least: float, most: int | None = None) -> DataFrame:
    """(itemset, support, count) by levels, until none is found or sets have `most` items.

    Baskets are cut down to their frequent items and counted by what is left, so that equal ones are one row; a level extends each row's frequent sets by its own
    later items, without a join, and is counted once.
    """
    one, total = _frequent(items, least)
    one = pinned(one)
    kept = items.distinct().join(one.select("item"), "item").groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    baskets = kept.groupBy("items").agg(F.count("*").alias("m"))
    out = one.select(F.array("item").alias("itemset"), F.col("c").alias("count"), "n")
    level = pinned(baskets).select("items", "m", F.explode(F.transform("items", lambda x: F.array(x))).alias("itemset"))
    size = 1
    while most is None or size < most:
        later = F.filter("items", lambda x: x > F.element_at("itemset", -1))
        bigger = level.select("items", "m", F.explode(F.transform(later, lambda x: F.concat("itemset", F.array(x)))).alias("itemset"))
        found = bigger.groupBy("itemset").agg(F.sum("m").alias("count")).join(F.broadcast(total)).where(F.col("count") >= least * F.col("n"))
        found = pinned(found)
        if found.isEmpty():
            break
        size += 1
        out = out.unionByName(found)
        level = bigger.join(found.select("itemset"), "itemset")
    return out.select("itemset", (F.col("count") / F.col("n")).alias("support"), "count", "n")


def rules(sets: DataFrame, confidence: float) -> DataFrame:
    """Rules with one item on the right, and their measures, from itemsets."""
    base = sets.select(F.array_sort("itemset").alias("s"), F.col("count").alias("n_both"), F.col("n").alias("n_all")).where(F.size("s") > 1)
    split = base.select("*", F.explode("s").alias("right")).withColumn("left", F.array_remove("s", F.col("right")))
    left = sets.select(F.array_sort("itemset").alias("left"), F.col("count").alias("n_left"))
    right = sets.where(F.size("itemset") == 1).select(F.element_at("itemset", 1).alias("right"), F.col("count").alias("n_right"))
    j = split.join(left, "left").join(right, "right")
    n, b, nl, nr = F.col("n_all"), F.col("n_both"), F.col("n_left"), F.col("n_right")
    out = j.select(
        F.array_join("left", " ").alias("left"), "right", (b / n).alias("support"), (b / nl).alias("confidence"), (nl / n).alias("coverage"), (nr / nl).alias("strength"),
        (n * b / (nl * nr)).alias("lift"), ((b * n - nl * nr) / (n * n)).alias("leverage"),
    )
    return out.where(F.col("confidence") >= confidence)


def applies(items: Column, side: Column) -> Column:
    """Whether a basket holds all items of a rule's side."""
    return F.size(F.array_except(side, items)) == 0


def classify(baskets: DataFrame, found: DataFrame, prefix: str) -> DataFrame:
    """Votes of the rules that apply and conclude a class item, by confidence. baskets: (key, items); few rules are broadcast if counted to be few."""
    from tarnwork.operators.relational import checked_broadcast

    concluding = found.where(F.col("right").startswith(prefix)).select(F.split("left", " ").alias("l"), "right", "confidence")
    votes = baskets.join(checked_broadcast(concluding), applies(F.col("items"), F.col("l"))).groupBy("key", "right").agg(F.sum("confidence").alias("v"))
    return votes.groupBy("key").agg(F.max_by("right", F.struct("v", "right")).alias("prediction"))
