"""Merkle manifest of a data set: a tree of hashes per group of rows, and one over the groups' roots, with a proof for each row.

Levels are made by windows: a window by group and parent's number holds the (at most `fan`) nodes of a run in order, so the full frame gives both what the
parent is the hash of and each node's siblings. A parent goes on to the next level once, with its first node. Paths to the root go down the levels by joins of a level
with its parents, of which there are `fan` times fewer. Texts are hashed where they are read and never move; what is shuffled is a few hashes per row.

Defined results: a null value is `-`, told apart from any text; a null group is a group of its own, before all others; rows of one key are ordered by their
hash, and rows alike in both are interchangeable; a null key comes first. A group of one row has that row's hash as its root and adds no siblings. An
empty table gives an empty manifest. Texts of any length are hashed whole. Other columns of the table, whatever their names, play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm.common import discard, placed, written


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` if unknown, else the number of bytes in UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(*map(field, values))


def fold(hash_: Column, path: Column) -> Column:
    """The root that a row's hash leads to by a path of siblings."""
    return F.aggregate(path, hash_, lambda below, step: digest(step["left"], below, step["right"]))


def siblings(path: Column) -> Column:
    """All siblings' hashes of a path, from the row to the root, put together."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def _levels(nodes: DataFrame, fan: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels from the leaves up, of the groups that still have several nodes there, and the roots (group, root, at) of those that end at each level, `at` of them.

    `nodes` has (_group, _no, _hash) and whatever a leaf carries; a level has these, _left and _right.
    """
    sizes = nodes.groupBy("_group").agg(F.count("*").alias("_size"))
    nodes = nodes.join(sizes, "_group")
    levels, roots = [], []
    while True:
        roots.append(nodes.where("_size = 1").select("_group", F.col("_hash").alias("_root")))
        run = Window.partitionBy("_group", "_parent").orderBy("_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        level = nodes.where("_size > 1").withColumn("_parent", F.floor(F.col("_no") / fan)).withColumn("_run", F.collect_list("_hash").over(run))
        own = (F.col("_no") % fan).cast("int")
        level = level.select(
            *(c for c in level.columns if c != "_run"),
            F.array_join(F.slice("_run", F.lit(1), own), "").alias("_left"), F.array_join(F.slice("_run", own + 2, F.lit(fan)), "").alias("_right"),
            F.when(own == 0, digest(F.array_join("_run", ""))).alias("_up"),
        )
        level = written(level, "merkle-level")
        if not level.limit(1).count():
            discard(level)
            return levels, roots
        levels.append(level)
        nodes = level.where(F.col("_up").isNotNull()).select("_group", F.col("_parent").alias("_no"), F.col("_up").alias("_hash"), F.ceil(F.col("_size") / fan).alias("_size"))


def _paths(levels: list[DataFrame], tops: list[DataFrame], carried: list[str]) -> DataFrame:
    """Leaves with their paths. tops[k]: (_group, _root, _path) of the groups that end at level k, their paths from their root on."""
    found: DataFrame | None = None
    for k in range(len(levels), -1, -1):
        here = tops[k].withColumn("_no", F.lit(0).cast("long"))
        if k < len(levels):
            above = found.select("_group", F.col("_no").alias("_parent"), "_root", F.col("_path").alias("_rest"))
            step = F.struct(F.col("_left").alias("left"), F.col("_right").alias("right"))
            level = levels[k].join(above, ["_group", "_parent"])
            level = level.withColumn("_path", F.concat(F.array(step), F.col("_rest")))
            kept = ["_group", "_no", "_root", "_path", *(carried if k == 0 else [])]
            here = level.select(kept) if k == 0 else level.select(kept).unionByName(here.select(kept))
        found = here
    return found


def manifest(docs: DataFrame, columns: list[str], key: str = "doc_id", group: str = "lang", fan: int = 8, also: dict[str, Column] | None = None) -> DataFrame:
    """Per row: its key, group, leaf (hash of the columns), subroot (of its group), root (of all), path (list of {left, right}: the siblings before and after it, level
    by level up to the root), and the columns of `also`, computed from the row. `fold(leaf, path)` is the root; of a row that is not as it was, it is not.
    """
    also = also or {}
    # No value of a real group begins as that of the null one does, and this one comes first.
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    hashed = written(docs.select(F.col(key).alias("_key"), named.alias("_group"), leaf([F.col(c) for c in columns]).alias("_hash"), *(c.alias(f"_also_{n}") for n, c in also.items())), "merkle-leaves")
    carried = ["_key", "_hash", *(f"_also_{n}" for n in also)]
    rows = placed(hashed, "_group", [F.col("_key"), F.col("_hash")], "_no")
    discard(hashed)
    levels, roots = _levels(rows, fan)
    subroots = written(reduce(DataFrame.unionByName, roots), "merkle-subroots")
    tops = subroots.select(F.lit("").alias("_group"), F.col("_group").alias("_of"), F.col("_root").alias("_hash"))
    over = placed(tops, "_group", [F.col("_of")], "_no")
    upper, root = _levels(over, fan)
    root = reduce(DataFrame.unionByName, root)
    empty = F.array().cast("array<struct<left: string, right: string>>")
    one = root.withColumn("_path", empty)
    if upper:
        above = _paths(upper, [one.limit(0)] * len(upper) + [one], ["_of", "_hash"]).select(F.col("_of").alias("_group"), F.col("_hash").alias("_subroot"), F.col("_root").alias("_top"), "_path")
    else:
        above = over.select(F.col("_of").alias("_group"), F.col("_hash").alias("_subroot"), F.col("_hash").alias("_top"), empty.alias("_path"))
    above = written(above, "merkle-top")
    ends = [r.join(above, "_group").select("_group", F.struct("_subroot", "_top").alias("_root"), "_path") for r in roots]
    # Groups of one leaf have no level.
    single = rows.join(ends[0], "_group").select("_group", "_no", "_root", "_path", *carried)
    found = _paths(levels, ends, carried).unionByName(single) if levels else single
    return found.select(
        F.col("_key").alias(key), F.when(F.col("_group") != "-", F.expr("substring(_group, 2)")).alias(group), F.col("_hash").alias("leaf"), F.col("_root._subroot").alias("subroot"),
        F.col("_root._top").alias("root"), F.col("_path").alias("path"), *(F.col(f"_also_{n}").alias(n) for n in also),
    )
