"""Sampling and splitting with exact counts: rows are ranked by a hash of their key, so results don't depend on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.operators.relational import numbered


def _hash(order: Sequence[str], seed: int) -> Column:
    """The same in any engine that has MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in order)))


def uniform(order: Sequence[str], seed: int = 0) -> Column:
    """A number in [0, 1) from a row's key: the same however rows are dealt to tasks, and when a task runs again."""
    return F.conv(F.substring(_hash(order, seed), 1, 13), 16, 10).cast("double") / float(1 << 52)


def normal(order: Sequence[str], seed: int = 0) -> Column:
    """A number of the standard normal distribution from a row's key (Box and Muller)."""
    return F.sqrt(-2 * F.ln(1 - uniform(order, 2 * seed))) * F.cos(2 * F.pi() * uniform(order, 2 * seed + 1))


def _ranked(df: DataFrame, order: Sequence[str], seed: int) -> DataFrame:
    return numbered(df.withColumn("_h", _hash(order, seed)), ["_h", *order], "_r").drop("_h")


def subset_two(df: DataFrame, p: float, order: Sequence[str], seed: int = 0, stratify: str | None = None, out: str = "subset") -> DataFrame:
    """0 for a share (p <= 1, of int(p * n + 0.5) rows) or a number of rows, 1 for the rest. Stratified, the share holds within each class."""
    if stratify:
        by = Window.partitionBy(stratify)
        ranked = df.withColumn("_r", F.row_number().over(by.orderBy(_hash(order, seed))) - 1).withColumn("_n", F.count("*").over(by))
    else:
        ranked = _ranked(df, order, seed).join(F.broadcast(df.agg(F.count("*").alias("_n"))))
    goal = F.floor(F.col("_n") * p + 0.5) if p <= 1 else F.lit(int(p))
    return ranked.withColumn(out, F.when(F.col("_r") < goal, 0).otherwise(1)).drop("_r", "_n")


def subset_many(df: DataFrame, shares: Sequence[float], order: Sequence[str], seed: int = 0, out: str = "subset") -> DataFrame:
    """Groups 0, 1, ... of the given shares, and the rest."""
    ranked = _ranked(df, order, seed).join(F.broadcast(df.agg(F.count("*").alias("_n"))))
    upto, group = 0.0, F.lit(0)
    for p in shares:
        upto += p
        group = group + F.when(F.col("_r") >= F.floor(F.col("_n") * upto + 0.5), 1).otherwise(0)
    return ranked.withColumn(out, group).drop("_r", "_n")


def folds(df: DataFrame, k: int, order: Sequence[str], seed: int = 0, stratify: str | None = None, out: str = "fold") -> DataFrame:
    """Fold numbers; sizes differ by one at most, within classes too if stratified."""
    keys = ["_c", "_h", *order] if stratify else ["_h", *order]
    ranked = df.withColumn("_h", _hash(order, seed))
    if stratify:
        ranked = ranked.withColumn("_c", F.col(stratify))
    return numbered(ranked, keys, "_r").withColumn(out, (F.col("_r") % k).cast("int")).drop("_h", "_r", "_c")


def with_replacement(df: DataFrame, n: int, order: Sequence[str], seed: int = 0) -> DataFrame:
    """n draws with replacement: draws are numbers of rows, joined to the rows."""
    rows = numbered(df, order, "_no")
    total = df.agg(F.count("*").alias("_n"))
    draws = df.sparkSession.range(n).join(F.broadcast(total)).select(F.floor(uniform(["id"], seed) * F.col("_n")).alias("_no"))
    return rows.join(draws, "_no").drop("_no")


def poisson_steps() -> list[float]:
    """Chances of at most 0, 1, 2... copies, as far as they can be told apart by the hash's 52 bits."""
    upto, p, out = 0.0, 0.36787944117144233, []
    while p > 2**-53:
        upto += p
        out.append(upto)
        p /= len(out)
    return out


def bootstrap(df: DataFrame, order: Sequence[str], seed: int = 0, replicas: int = 1, out: str = "replica") -> DataFrame:
    """Replicas by Poisson(1) numbers of copies per row, each replica on its own, without any shuffle (`with_replacement` draws an exact number of rows)."""
    steps = sum((F.when(F.col("_u") > upto, 1).otherwise(0) for upto in poisson_steps()), F.lit(0))
    every = df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(replicas - 1)))).withColumn("_u", uniform([out, *order], seed)).withColumn("_k", steps)
    # Rows of no copies go by exploding nothing: a condition on the copies would be pushed down, and hash a row anew for every step.
    return every.withColumn("_i", F.explode(F.array_repeat(F.lit(1), F.col("_k")))).drop("_u", "_k", "_i")


def sample(df: DataFrame, order: Sequence[str], n: int | None = None, share: float | None = None, seed: int = 0) -> DataFrame:
    """An exact number, or share, of rows."""
    if n is not None:
        return df.orderBy(_hash(order, seed), *order).limit(n)
    return subset_two(df, share, order, seed).where("subset = 0").drop("subset")


def random_row(df: DataFrame, order: Sequence[str], seed: int = 0) -> DataFrame:
    return sample(df, order, n=1, seed=seed)
