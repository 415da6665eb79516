"""Feature scores, all from one contingency of every attribute with the class; selection of features by score."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.operators.aggregate import domain_contingency
from tarnwork.operators.relational import checked_broadcast, numbered, running, spread
from tarnwork.session import pinned

#: What sums of differences may be apart by rounding, with room to spare.
ROOM = 1e-11


def _h(w: Column, total: Column) -> Column:
    """Sum of -p log2 p in an aggregation over weights."""
    p = w / total
    return F.sum(F.when(w > 0, -p * F.log2(p)).otherwise(0.0))


def _tables(df: DataFrame, names: Sequence[str], class_name: str) -> DataFrame:
    """(attribute, value, class, weight, of value, of class, known, all): weights of known values with their margins. Windows run over counts."""
    t = domain_contingency(df.where(F.col(class_name).isNotNull()), names, class_name)
    a = Window.partitionBy("attribute")
    t = t.withColumn("all", F.sum("weight").over(a)).where("value is not null")
    return t.select("*", F.sum("weight").over(a).alias("known"), F.sum("weight").over(Window.partitionBy("attribute", "value")).alias("w_value"), F.sum("weight").over(Window.partitionBy("attribute", "class")).alias("w_class"))


def score_all(df: DataFrame, names: Sequence[str], class_name: str) -> DataFrame:
    """info_gain, gain_ratio, gini (half), relevance, distance and chi-square of every discrete attribute, in one job.

    Unknown values reduce a score by their share.
    """
    t = _tables(df, names, class_name)
    n, w, v, c = F.col("known"), F.col("weight"), F.col("w_value"), F.col("w_class")
    joint = t.groupBy("attribute").agg(
        F.first("all").alias("all"), F.first("known").alias("n"), F.sum(-w / n * F.log2(w / n)).alias("h_joint"), F.sum(w * w / v / n).alias("g_given"),
        F.sum(w * w / (v * c)).alias("chi_part"),
    )
    of_value = t.groupBy("attribute", "value").agg(F.first("w_value").alias("x"), F.first("known").alias("n"), F.max("weight").alias("m"))
    of_value = of_value.groupBy("attribute").agg(_h(F.col("x"), F.col("n")).alias("h_value"), F.sum("m").alias("m_value"))
    of_class = t.groupBy("attribute", "class").agg(F.first("w_class").alias("x"), F.first("known").alias("n"))
    of_class = of_class.groupBy("attribute").agg(_h(F.col("x"), F.col("n")).alias("h_class"), F.sum(F.col("x") * F.col("x") / (F.col("n") * F.col("n"))).alias("g_class"), F.max("x").alias("m_class"))
    s = joint.join(of_value, "attribute").join(of_class, "attribute")
    share = F.col("n") / F.col("all")
    zero = lambda x: F.when(F.abs(x) < 1e-6, 0.0).otherwise(x)
    gain = F.col("h_class") + F.col("h_value") - F.col("h_joint")
    left = F.col("n") - F.col("m_class")
    return s.select(
        "attribute", zero(gain * share).alias("info_gain"), zero(F.when(F.col("h_value") < 1e-6, 0.0).otherwise(gain / F.col("h_value")) * share).alias("gain_ratio"),
        zero((F.col("g_given") - F.col("g_class")) / 2 * share).alias("gini"), F.when(left > 0, (F.col("m_value") - F.col("m_class")) / left).otherwise(0.0).alias("relevance"),
        F.when(F.col("h_joint") > 0, gain / F.col("h_joint")).otherwise(0.0).alias("distance"), (F.col("n") * (F.col("chi_part") - 1)).alias("chi_square"),
    )


def mse(df: DataFrame, names: Sequence[str], class_name: str) -> DataFrame:
    """Relative reduction of a continuous class's variance by each discrete attribute."""
    y = F.col(class_name).cast("double")
    long = df.where(y.isNotNull()).select(y.alias("y"), *(F.col(c).cast("string").alias(c) for c in names)).unpivot("y", list(names), "attribute", "value")
    g = long.groupBy("attribute", "value").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    known = F.col("value").isNotNull()
    pick = lambda x: F.sum(F.when(known, x))
    out = g.groupBy("attribute").agg(F.sum("n").alias("all"), pick(F.col("n")).alias("n"), pick(F.col("s")).alias("s"), pick(F.col("q")).alias("q"), pick(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("inside"))
    whole = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return out.select("attribute", F.when(whole > 0, (1 - F.col("inside") / whole) * F.col("n") / F.col("all")).otherwise(0.0).alias("mse"))


def log_odds(df: DataFrame, name: str, value: str, class_name: str, positive: str) -> DataFrame:
    """ln of the odds ratio of a binary attribute and class; +-999999 where a cell is empty."""
    a, y = F.col(name) == value, F.col(class_name) == positive
    cells = df.agg(*(F.count_if(p & q).cast("double").alias(n) for n, p, q in (("a", a, y), ("b", a, ~y), ("c", ~a, y), ("d", ~a, ~y))))
    up, down = F.col("a") * F.col("d"), F.col("b") * F.col("c")
    return cells.select(F.when(down == 0, 999999.0).when(up == 0, -999999.0).otherwise(F.ln(up / down)).alias("log_odds"))


def thresholds(df: DataFrame, name: str, class_name: str) -> DataFrame:
    """(cut, gain): information gain of every binary cut of a continuous column, from running totals over distinct values."""
    t = df.where(F.col(name).isNotNull() & F.col(class_name).isNotNull()).groupBy(F.col(name).alias("x"), F.col(class_name).alias("y")).agg(F.count("*").cast("double").alias("w"))
    every = t.select("x").distinct().join(t.select("y").distinct()).join(t, ["x", "y"], "left").select("x", "y", F.coalesce("w", F.lit(0.0)).alias("w"))  # distinct values by classes
    c = running(every, ["x"], {"l": "w"}, ["y"]).join(t.groupBy("y").agg(F.sum("w").alias("t")), "y").withColumn("r", F.col("t") - F.col("l"))
    g = c.groupBy("x").agg(*(F.sum(k).alias(k.upper()) for k in "ltr"), *(F.sum(F.when(F.col(k) > 0, F.col(k) * F.log2(k)).otherwise(0.0)).alias(f"e{k}") for k in "ltr"))
    ent = lambda k: F.when(F.col(k.upper()) > 0, F.col(k.upper()) * F.log2(k.upper())).otherwise(0.0) - F.col(f"e{k}")
    gain = (ent("t") - ent("l") - ent("r")) / F.col("T")
    values = numbered(t.select("x").distinct(), ["x"], "no")
    middle = values.join(values.select((F.col("no") - 1).alias("no"), F.col("x").alias("next")), "no").select("x", ((F.col("x") + F.col("next")) / 2).alias("cut"))
    return g.join(middle, "x").select("cut", gain.alias("gain"))


def best_threshold(df: DataFrame, name: str, class_name: str) -> DataFrame:
    return thresholds(df, name, class_name).orderBy(F.col("gain").desc(), "cut").limit(1)


def best_value(df: DataFrame, name: str, class_name: str) -> DataFrame:
    """The value whose split from the rest gains most."""
    t = df.where(F.col(name).isNotNull() & F.col(class_name).isNotNull()).groupBy(F.col(name).alias("v"), F.col(class_name).alias("y")).agg(F.count("*").cast("double").alias("w"))
    every = t.select("v").distinct().join(t.select("y").distinct()).join(t, ["v", "y"], "left").select("v", "y", F.coalesce("w", F.lit(0.0)).alias("l"))
    c = every.withColumn("t", F.sum("l").over(Window.partitionBy("y"))).withColumn("r", F.col("t") - F.col("l"))
    g = c.groupBy("v").agg(*(F.sum(k).alias(k.upper()) for k in "ltr"), *(F.sum(F.when(F.col(k) > 0, F.col(k) * F.log2(k)).otherwise(0.0)).alias(f"e{k}") for k in "ltr"))
    ent = lambda k: F.when(F.col(k.upper()) > 0, F.col(k.upper()) * F.log2(k.upper())).otherwise(0.0) - F.col(f"e{k}")
    return g.select(F.col("v").alias("value"), ((ent("t") - ent("l") - ent("r")) / F.col("T")).alias("gain")).orderBy(F.col("gain").desc(), "value").limit(1)


# -- Relief: nearest rows of each class around reference rows, in one table that all its scores come from ---------


@dataclass
class Neighbourhood:
    """pairs: (ref, key, weight, both) and of each column c a_c, b_c (the reference row's value and the neighbour's) and d_c (their difference); m reference rows.

    For a class, `weight` is below 0 for neighbours of the reference row's class and above 0 for others, and each class's add up to its share's; for a value,
    `weight` is the difference of values and `both` is 1, over the number of neighbours.
    """

    pairs: DataFrame
    m: int
    regression: bool


def relief_neighbours(df: DataFrame, continuous: Sequence[str], discrete: Sequence[str], class_name: str, key: str, m: int = 100, k: int = 10, regression: bool = False) -> Neighbourhood:
    """The k nearest rows of each class (or of all, for a value) around m reference rows (a bound, by hash), ties with the kth too; rows at no distance are none.

    A difference is 0 or 1 for discrete values, else a share of the column's span. With an unknown value it is that of the known one from the column's average,
    or the chance that a value drawn from the column is another one; of two unknown ones it is 0.5, or the chance that two drawn ones differ. Rows of an
    unknown class or value are left out.
    """
    rows = df.where(F.col(class_name).isNotNull()).select(F.col(key).alias("key"), F.col(class_name).alias("y"), *continuous, *discrete)
    spans = rows.agg(*(f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate([*continuous, *(["y"] if regression else [])]) for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg)))).first()
    known, alike = rows, {}
    for c in discrete:  # each row's value with its share among the known ones
        n = known.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n"))
        shares = pinned(n.join(F.broadcast(n.agg(F.sum("_n").alias("_all"))), how="cross").select(F.col(c).alias("_v"), (F.col("_n") / F.col("_all")).alias(f"p_{c}")))
        alike[c] = shares.agg(F.sum(F.col(f"p_{c}") * F.col(f"p_{c}"))).first()[0]
        rows = rows.join(checked_broadcast(shares), F.col(c) == F.col("_v"), "left").drop("_v")
    every = [*continuous, *discrete]
    if not regression:
        sizes = known.groupBy("y").agg(F.count("*").alias("_n"))
        sizes = sizes.join(F.broadcast(sizes.agg(F.sum("_n").alias("_all"))), how="cross").select(F.col("y").alias("_c"), (F.col("_n") / F.when(F.col("_all") > F.col("_n"), F.col("_all") - F.col("_n"))).alias("odds"))
        rows = rows.join(checked_broadcast(pinned(sizes)), F.col("y") == F.col("_c")).drop("_c")
    ref = rows.orderBy(F.md5(F.col("key").cast("string")), "key").limit(m).select(F.col("key").alias("ref"), F.col("y").alias("y_ref"), *(F.col(c).alias(f"a_{c}") for c in every), *(F.col(f"p_{c}").alias(f"q_{c}") for c in discrete))

    def apart(i: int, a: Column, b: Column) -> Column:
        span, mean = (spans[f"hi{i}"] or 0.0) - (spans[f"lo{i}"] or 0.0), F.lit(spans[f"mean{i}"])
        if span <= 0:
            return F.lit(0.0)
        return F.when(a.isNull() & b.isNull(), 0.5).otherwise(F.abs(F.coalesce(a, mean) - F.coalesce(b, mean)) / span)

    def differ(c: str) -> Column:
        a, b = F.col(f"a_{c}"), F.col(c)
        twice = 1 - alike[c] if alike[c] is not None else 0.0
        return F.when(a.isNull() & b.isNull(), twice).when(a.isNull(), 1 - F.col(f"p_{c}")).when(b.isNull(), 1 - F.col(f"q_{c}")).otherwise((a != b).cast("double"))

    ref = pinned(ref.withColumn("_at", F.monotonically_increasing_id()))
    of = ["ref"] if regression else ["ref", "y"]
    pairs = _candidates(spread(rows), ref, continuous, discrete, spans, alike, k, "y" if not regression else None).join(F.broadcast(ref), "_at")
    pairs = pairs.withColumns({f"d_{c}": apart(i, F.col(f"a_{c}"), F.col(c)) for i, c in enumerate(continuous)} | {f"d_{c}": differ(c) for c in discrete})
    pairs = pairs.withColumn("_s", reduce(lambda a, b: a + b, (F.col(f"d_{c}") for c in every)))
    pairs = pairs.withColumn("_d", F.round("_s", 12)).where("_d > 0")
    near = pairs.withColumn("_r", F.rank().over(Window.partitionBy(*of).orderBy("_d"))).where(F.col("_r") <= k).withColumn("_n", F.count("*").over(Window.partitionBy(*of)))
    if regression:
        weight = apart(len(continuous), F.col("y_ref"), F.col("y"))
    else:
        weight = F.when(F.col("y") == F.col("y_ref"), -1.0).otherwise(F.col("odds"))
    out = near.select("ref", "key", (weight / F.col("_n")).alias("weight"), (1 / F.col("_n")).alias("both"), *(F.col(f"{n}_{c}") for c in every for n in "ad"), *(F.col(c).alias(f"b_{c}") for c in every))
    return Neighbourhood(pinned(out), ref.count(), regression)


def _candidates(rows: DataFrame, ref: DataFrame, continuous: Sequence[str], discrete: Sequence[str], spans: Row, alike: dict, k: int, of: str | None) -> DataFrame:
    """Rows with the places `_at` of `ref` to which they may be one of the k nearest (of their class `of`): each task passes on what is no farther than the k-th nearest that it has met so far.

    Distances are those of `relief_neighbours`, but for their rounding, for which there is room.
    """
    refs = ref.orderBy("_at").collect()  # m of them
    names = rows.columns
    known = {c: [r[f"a_{c}"] for r in refs] for c in [*continuous, *discrete]}
    chance = {c: np.array([np.nan if r[f"q_{c}"] is None else r[f"q_{c}"] for r in refs]) for c in discrete}
    keys: dict[object, list[int]] = {}
    for n, r in enumerate(refs):
        keys.setdefault(r["ref"], []).append(n)
    at_ref = [r["_at"] for r in refs]
    width = [(spans[f"hi{i}"] or 0.0) - (spans[f"lo{i}"] or 0.0) for i in range(len(continuous))]
    mean = [spans[f"mean{i}"] for i in range(len(continuous))]
    refs = [r["ref"] for r in refs]

    def numbers(column: pa.Array) -> np.ndarray:
        return column.cast(pa.float64()).to_numpy(zero_copy_only=False)

    def distances(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((len(refs), batch.num_rows))
        for i, c in enumerate(continuous):
            if width[i] > 0:
                column = batch.column(c)
                x, none = numbers(column), column.is_null().to_numpy(zero_copy_only=False)
                x, a = np.where(none, mean[i], x), np.array([mean[i] if v is None else float(v) for v in known[c]])
                d = np.abs(a[:, None] - x) / width[i]
                d[np.ix_([v is None for v in known[c]], none)] = 0.5
                total += d
        for c in discrete:
            coded = batch.column(c).dictionary_encode()
            at = {v: n for n, v in enumerate(coded.dictionary.to_pylist())}
            x = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            a = np.array([-1 if v is None else at.get(v, -2) for v in known[c]])
            d = (a[:, None] != x).astype(float)
            none, p = x == -1, numbers(batch.column(f"p_{c}"))
            d[a == -1] = 1 - p
            d[:, none] = (1 - chance[c])[:, None]
            d[np.ix_(a == -1, none)] = 1 - alike[c] if alike[c] is not None else 0.0
            total += d
        for row in np.flatnonzero(pa.compute.is_in(batch.column("key"), value_set=pa.array(refs, batch.schema.field("key").type)).to_numpy(zero_copy_only=False)):
            total[keys[batch.column("key")[row].as_py()], row] = -1.0  # the row itself
        total[:, batch.column("key").is_null().to_numpy(zero_copy_only=False)] = -1.0
        return np.where(np.isnan(total), np.inf, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest: dict[object, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows or not refs:
                continue
            d = distances(batch)
            groups = [(None, np.arange(batch.num_rows))]
            if of:
                coded = batch.column(of).dictionary_encode()
                groups = [(v, np.flatnonzero(coded.indices.to_numpy() == n)) for n, v in enumerate(coded.dictionary.to_pylist())]
            rows_, refs_ = [], []
            for name, at in groups:
                own = d[:, at]
                best = np.concatenate([nearest.get(name, np.full((len(refs), k), np.inf)), np.where(own > 2 * ROOM, own, np.inf)], axis=1)
                best = nearest[name] = np.partition(best, k - 1, axis=1)[:, :k]
                r, x = np.nonzero((own > 0) & (own <= best.max(1)[:, None] + ROOM))
                rows_.append(at[x])
                refs_.append(r)
            rows_, refs_ = np.concatenate(rows_), np.concatenate(refs_)
            if len(rows_):
                out = batch.take(pa.array(rows_))
                yield pa.RecordBatch.from_arrays([*(out.column(c) for c in names), pa.array(np.array(at_ref)[refs_])], names=[*names, "_at"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_at", T.LongType())]))



def _relief_gain(n: Neighbourhood, d: Column) -> tuple[list[Column], Column]:
    """Sums over pairs, named w, b and c, and the score that they make."""
    if not n.regression:
        return [F.sum(F.col("weight") * d).alias("w")], F.col("w") / n.m
    sums = [F.sum(F.col("weight") * d).alias("w"), F.sum(F.col("both") * d).alias("b")]
    apart = n.pairs.agg(F.sum("weight")).first()[0] or 0.0
    return sums, (F.col("w") / apart if apart else F.lit(0.0)) - ((F.col("b") - F.col("w")) / (n.m - apart) if n.m != apart else F.lit(0.0))


def relief_scores(n: Neighbourhood, names: Sequence[str]) -> DataFrame:
    """ReliefF (or RReliefF, for a value) of each column."""
    long = n.pairs.select("weight", "both", F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(f"d_{c}").alias("d")) for c in names))).alias("_s")).select("weight", "both", "_s.*")
    sums, score = _relief_gain(n, F.col("d"))
    return long.groupBy("attribute").agg(*sums).select("attribute", score.alias("relief"))


def relief(df: DataFrame, names: Sequence[str], class_name: str, key: str, m: int = 100, k: int = 10, discrete: Sequence[str] = (), regression: bool = False) -> DataFrame:
    return relief_scores(relief_neighbours(df, names, discrete, class_name, key, m, k, regression), [*names, *discrete])


def relief_gains(n: Neighbourhood, name: str) -> DataFrame:
    """(a, b, gain), a < b: what telling two values of a discrete column apart adds to its score, from pairs where both are known."""
    a, b = F.col(f"a_{name}"), F.col(f"b_{name}")
    sums, score = _relief_gain(n, F.col(f"d_{name}"))
    return n.pairs.where(a != b).groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(*sums).select("a", "b", score.alias("gain"))


def relief_thresholds(n: Neighbourhood, name: str) -> DataFrame:
    """(cut, gain) for each cut halfway between values that are next to each other in the pairs: the score of the column cut in two there, from pairs where both are known."""
    a, b = F.col(f"a_{name}"), F.col(f"b_{name}")
    sums, score = _relief_gain(n, F.col("s"))
    known = n.pairs.where(a.isNotNull() & b.isNotNull())
    ends = known.select("weight", "both", F.least(a, b).alias("x"), F.lit(1).alias("s")).unionByName(known.select("weight", "both", F.greatest(a, b).alias("x"), F.lit(-1).alias("s")))
    upto = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most two rows a pair, and pairs are bounded by m and k
    at = ends.groupBy("x").agg(*sums)
    at = at.withColumns({c: F.sum(c).over(upto) for c in at.columns if c != "x"}).withColumn("_next", F.lead("x").over(Window.orderBy("x")))
    return at.where(F.col("_next").isNotNull()).select(((F.col("x") + F.col("_next")) / 2).alias("cut"), score.alias("gain"))


def mdl(df: DataFrame, names: Sequence[str], class_name: str) -> DataFrame:
    """Description-length score of each attribute, from the contingency's counts: the classes' over all rows (of a known class) less the values', per row."""
    import math

    import pandas as pd

    t = domain_contingency(df.where(F.col(class_name).isNotNull()), names, class_name)

    def lm(counts: list[float]) -> float:
        return (math.lgamma(sum(counts) + 1) - sum(math.lgamma(c + 1) for c in counts)) / math.log(2)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        classes = rows.groupby("class")["weight"].sum()
        n, k = classes.sum(), len(classes)
        prior = lm(list(classes)) + lm([n, k - 1])
        post = sum(lm(list(g["weight"])) + lm([g["weight"].sum(), k - 1]) for _, g in rows.groupby("value"))  # unknown values are left out
        return pd.DataFrame({"attribute": [rows["attribute"].iloc[0]], "mdl": [(prior - post) / n]})

    return t.groupBy("attribute").applyInPandas(one, "attribute string, mdl double")


def ranked(scores: DataFrame, by: str) -> DataFrame:
    return scores.select("attribute", F.col(by).alias("score")).orderBy(F.col("score").desc(), "attribute")


def select_best(df: DataFrame, scores: DataFrame, by: str, n: int, keep: Sequence[str]) -> DataFrame:
    """The n best attributes and the columns to keep."""
    best = [r[0] for r in ranked(scores, by).limit(n).collect()]
    return df.select(*best, *keep)


def select_above(df: DataFrame, scores: DataFrame, by: str, least: float, keep: Sequence[str]) -> DataFrame:
    chosen = {r[0] for r in scores.where(F.col(by) >= least).collect()}
    return df.select(*(c for c in df.columns if c in chosen or c in keep))
