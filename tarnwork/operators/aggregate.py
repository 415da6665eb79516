"""Grouped and weighted aggregates, distributions, contingency tables, percentiles, survival."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.operators.relational import running


def _w(weight: Column | None) -> Column:
    return F.lit(1.0) if weight is None else weight


# -- aggregates of group_by: name -> (value, order of rows) -> Column ------------------------


def geometric_mean(x: Column) -> Column:
    """(product)^(1/n): 0 with a zero, unknown for a negative product."""
    odd = F.sum(F.when(x < 0, 1).otherwise(0)) % 2 == 1
    zero = F.coalesce(F.bool_or(x == 0), F.lit(False))
    return F.when(zero, 0.0).when(odd, None).otherwise(F.exp(F.avg(F.ln(F.abs(F.nullif(x, F.lit(0)))))))


def harmonic_mean(x: Column) -> Column:
    """n / sum(1 / x), zeros counting as 1e-6."""
    return F.count(x) / F.sum(1 / F.when(x == 0, 1e-6).otherwise(x))


AGGREGATES: dict[str, Callable[[Column, Column], Column]] = {
    "first": lambda x, o: F.min_by(x, o),
    "last": lambda x, o: F.max_by(x, o),
    "random": lambda x, o: F.max_by(x, F.struct(F.md5(F.to_json(o)), o)),
    "modus": lambda x, o: F.mode(x, deterministic=True),
    "mean": lambda x, o: F.avg(x),
    "geometric mean": lambda x, o: geometric_mean(x),
    "harmonic mean": lambda x, o: harmonic_mean(x),
    "min": lambda x, o: F.min(x),
    "max": lambda x, o: F.max(x),
    "sum": lambda x, o: F.coalesce(F.sum(x), F.lit(0)),
    "count": lambda x, o: F.count(F.lit(1)),
    "join": lambda x, o: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), F.coalesce(x.cast("string"), F.lit("?")).alias("v")))), lambda s: s["v"]), ", "),
}


def group_by(df: DataFrame, keys: Sequence[str], how: dict[str, str | Callable[[Column, Column], Column]], order: Sequence[str]) -> DataFrame:
    """One row per key combination (unknown is a key too); `order` is a unique key of the rows, for what depends on their order."""
    o = F.struct(*order)
    return df.groupBy(*keys).agg(*((AGGREGATES[h] if isinstance(h, str) else h)(F.col(c), o).alias(c) for c, h in how.items()))


def pivot_with_margins(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Counts and statistics of `value` for each cell, row, column and the whole: one cube. Unknown axes are left out."""
    known = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    cells = known.cube(row, column).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.min(value).alias("low"), F.max(value).alias("high"))
    return cells.select(F.coalesce(F.col(row).cast("string"), F.lit("(all)")).alias("row"), F.coalesce(F.col(column).cast("string"), F.lit("(all)")).alias("col"), "n", "total", "mean", "deviation", "low", "high")


# -- statistics -------------------------------------------------------------------------


def basic_statistics(df: DataFrame, names: Sequence[str], weight: Column | None = None) -> DataFrame:
    """n, sum, sum of squares, min, max, mean and population deviation of all columns, in one scan."""
    long = df.select(_w(weight).alias("w"), *(F.col(c).cast("double").alias(c) for c in names)).unpivot("w", list(names), "attribute", "x")
    w, x = F.when(F.col("x").isNotNull(), F.col("w")), F.col("x")
    n, s, q = F.sum(w), F.sum(w * x), F.sum(w * x * x)
    some = F.coalesce(n, F.lit(0.0)) > 0
    deviation = F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))
    return long.groupBy("attribute").agg(F.coalesce(n, F.lit(0.0)).alias("n"), s.alias("sum"), q.alias("sum2"), F.min(x).alias("min"), F.max(x).alias("max"), F.when(some, s / n).otherwise(-1.0).alias("avg"), F.when(some, deviation).otherwise(-1.0).alias("dev"))


def distribution(df: DataFrame, name: str, values: Sequence[str] | None = None, weight: Column | None = None) -> DataFrame:
    """(value, weight): of a discrete column all `values`, those without rows too; of a continuous one those there are. Unknown is left out."""
    found = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.sum(_w(weight)).alias("weight"))
    if values is None:
        return found
    every = df.sparkSession.createDataFrame([(v,) for v in values], "value string")
    return every.join(found, "value", "left").select("value", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def domain_distributions(df: DataFrame, names: Sequence[str], weight: Column | None = None) -> DataFrame:
    """(attribute, value, weight) of all columns, in one scan and one shuffle; unknown values as NULL."""
    long = df.select(_w(weight).alias("_w"), *(F.col(c).cast("string").alias(c) for c in names)).unpivot("_w", list(names), "attribute", "value")
    return long.groupBy("attribute", "value").agg(F.sum("_w").alias("weight"))


def moments(df: DataFrame, name: str) -> DataFrame:
    x = F.col(name)
    return df.agg(F.avg(x).alias("average"), F.var_pop(x).alias("var"), F.stddev_pop(x).alias("dev"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("error"))


def percentiles(df: DataFrame, name: str, points: Sequence[float], groups: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Weighted percentiles: the first value whose weights up to it exceed the share, or the mean with the next where they hit it exactly.

    Works on running totals of (value, weight) after aggregation.
    """
    counts = df.where(F.col(name).isNotNull()).groupBy(*groups, F.col(name).alias("x")).agg(F.sum(_w(weight)).alias("w"))
    if not groups:
        counts = counts.withColumn("_g", F.lit(0))
    keys = list(groups) or ["_g"]
    counts = running(counts, ["x"], {"upto": "w"}, keys)
    whole = counts.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(F.max("upto").alias("all"))
    counts = counts.join(whole, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys)))

    def at(p: float) -> Column:
        if p <= 0:
            return F.min("x")
        if p >= 100:
            return F.max("x")
        goal = F.col("all") * p / 100
        here, beyond = (F.min(F.when(F.col("upto") > goal + e, F.col("x"))) for e in (-1e-9, 1e-9))  # they differ where the share is hit
        return F.when(here == beyond, here).otherwise((here + F.coalesce(beyond, here)) / 2)

    return counts.groupBy(*keys).agg(*(at(p).alias(f"p{p:g}") for p in points)).drop("_g")


def density(df: DataFrame, name: str) -> DataFrame:
    """Relative frequency of each value."""
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(total)).select("value", (F.col("n") / F.col("all")).alias("p"))  # one row beside each


def gaussian(df: DataFrame, name: str, at: Column) -> DataFrame:
    """The fitted normal density at a column's values."""
    fit = df.agg(F.avg(name).alias("_m"), F.stddev_pop(name).alias("_s"))
    z = (at - F.col("_m")) / F.col("_s")
    return df.join(F.broadcast(fit)).withColumn("pdf", F.exp(-z * z / 2) / (F.col("_s") * F.sqrt(2 * F.pi()))).drop("_m", "_s")


# -- contingency: the kernel of scoring, naive Bayes and trees -------------------------------


def contingency(df: DataFrame, outer: str, inner: str, weight: Column | None = None) -> DataFrame:
    """(outer, inner, weight), unknown on either side as NULL."""
    return df.groupBy(F.col(outer).alias("outer"), F.col(inner).alias("inner")).agg(F.sum(_w(weight)).alias("weight"))


def domain_contingency(df: DataFrame, names: Sequence[str], class_name: str, weight: Column | None = None) -> DataFrame:
    """(attribute, value, class, weight) of every attribute with the class: one scan, one shuffle of counts."""
    long = df.select(_w(weight).alias("_w"), F.col(class_name).cast("string").alias("class"), *(F.col(c).cast("string").alias(c) for c in names)).unpivot(["_w", "class"], list(names), "attribute", "value")
    return long.groupBy("attribute", "value", "class").agg(F.sum("_w").alias("weight"))


def conditional(table: DataFrame, given: Sequence[str]) -> DataFrame:
    """Weights as probabilities within each group."""
    return table.withColumn("p", F.col("weight") / F.sum("weight").over(Window.partitionBy(*given)))


def estimates(df: DataFrame, name: str, m: float = 2.0) -> DataFrame:
    """Relative, Laplace and m-estimates (towards equal shares) of each value's probability."""
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("all"), F.count("*").alias("k"))
    n, a, k = F.col("n"), F.col("all"), F.col("k")
    return counts.join(F.broadcast(whole)).select("value", (n / a).alias("relative"), ((n + 1) / (a + k)).alias("laplace"), ((n + m / k) / (a + m)).alias("m_estimate"))


def conditional_estimates(df: DataFrame, outer: str, inner: str, m: float = 2.0) -> DataFrame:
    """(outer, inner, p): m-estimates of P(inner | outer), towards the shares of all rows; pairs that occur."""
    t = contingency(df.where(F.col(outer).isNotNull() & F.col(inner).isNotNull()), outer, inner)
    given = t.groupBy(F.col("outer").alias("_o")).agg(F.sum("weight").alias("_t"))
    prior = t.groupBy(F.col("inner").alias("_i")).agg(F.sum("weight").alias("_n")).join(F.broadcast(t.agg(F.sum("weight").alias("_all"))))
    joined = t.join(given, F.col("outer") == F.col("_o")).join(prior, F.col("inner") == F.col("_i"))
    return joined.select("outer", "inner", ((F.col("weight") + m * F.col("_n") / F.col("_all")) / (F.col("_t") + m)).alias("p"))


def summary(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(attribute, known, unknown, low, high, mean) of continuous columns, in one scan."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in names)).unpivot([], list(names), "attribute", "x")
    return long.groupBy("attribute").agg(F.count("x").alias("known"), F.count_if(F.col("x").isNull()).alias("unknown"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"))


def pearson_matrix(df: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """Correlation of each column with a target, all in one aggregation."""
    long = df.select(F.col(target).cast("double").alias("_y"), *(F.col(c).cast("double").alias(c) for c in names)).unpivot("_y", list(names), "attribute", "x")
    r, n = F.corr("x", "_y"), F.count_if(F.col("x").isNotNull() & F.col("_y").isNotNull())
    out = long.groupBy("attribute").agg(r.alias("r"), n.alias("n"))
    return out.select("attribute", "r", (F.col("n") - 2).alias("df"), (F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))).alias("t"))


def average_ranks(df: DataFrame, name: str, out: str, groups: Sequence[str] = ()) -> DataFrame:
    """Ranks of known values, ties sharing their mean, from running totals over distinct values."""
    keys = list(groups)
    counts = df.where(F.col(name).isNotNull()).groupBy(*keys, F.col(name).alias("_x")).agg(F.count("*").alias("_n"))
    ranks = running(counts, ["_x"], {"_upto": "_n"}, keys).select(*keys, "_x", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))
    test = F.col(name) == F.col("_x")
    for k in keys:
        ranks = ranks.withColumnRenamed(k, f"_k_{k}")
        test &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(ranks, test).drop("_x", *(f"_k_{k}" for k in keys))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    return average_ranks(average_ranks(known, "_a", "_ra"), "_b", "_rb").agg(F.corr("_ra", "_rb").alias("rho"))


def kaplan_meier(df: DataFrame, time: str, event: Column) -> DataFrame:
    """(time, at_risk, events, survival): the product-limit curve, over distinct times."""
    t = df.where(F.col(time).isNotNull()).groupBy(F.col(time).alias("time")).agg(F.sum(event.cast("long")).alias("events"), F.count("*").alias("n"))
    t = running(t, [F.col("time").desc()], {"at_risk": "n"})
    everyone = F.col("events") == F.col("at_risk")  # nothing survives from here on
    t = t.withColumn("_step", F.when(everyone, 0.0).otherwise(F.ln(1 - F.col("events") / F.col("at_risk")))).withColumn("_end", everyone.cast("int"))
    t = running(t, ["time"], {"_sum": "_step", "_ends": "_end"})
    return t.select("time", "at_risk", "events", F.when(F.col("_ends") > 0, 0.0).otherwise(F.exp("_sum")).alias("survival")).where("events > 0")


def data_info(df: DataFrame, class_name: str) -> DataFrame:
    """Rows, columns by type, and distinct classes."""
    kinds = dict(df.dtypes)
    numeric = sum(k in ("int", "bigint", "double", "float") for k in kinds.values())
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(kinds)).cast("long").alias("n_columns"), F.lit(numeric).cast("long").alias("n_continuous"), F.count_distinct(class_name).alias("n_classes"))
