"""Column transformers: discretization, imputation, continuization, noise, weights. Each fits by one small aggregation and applies as expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.operators.aggregate import percentiles
from tarnwork.operators.relational import numbered, running
from tarnwork.operators.sampling import normal, uniform
from tarnwork.schema import domain_of
from tarnwork.session import pinned


def _digits(step: float) -> int:
    return max(2, math.ceil(-math.log10(min(step, 1.0)))) if step > 0 else 2


def _rounded(x: float, digits: int) -> float:
    return math.floor(x * 10**digits + 0.5) / 10**digits


def equal_width_cuts(df: DataFrame, names: Sequence[str], n: int) -> dict[str, tuple[float, float]]:
    """(first cut, step) of each column, rounded to the digits that the step calls for: one aggregation for all columns."""
    row = df.agg(*(f(c).alias(f"{c}_{k}") for c in names for k, f in (("lo", F.min), ("hi", F.max)))).first()
    out = {}
    for c in names:
        lo, hi = row[f"{c}_lo"], row[f"{c}_hi"]
        if lo is not None:
            step = (hi - lo) / n
            out[c] = (_rounded(lo + step, _digits(step)), _rounded(step, _digits(step)))
    return out


def equal_width(x: Column, first: float, step: float, n: int) -> Column:
    """Bin of [a, b) intervals: 0 below the first cut, at most n - 1."""
    if step <= 0:
        return F.when(x.isNotNull(), F.lit(0))
    return F.when(x < first, 0).otherwise(F.least(F.lit(n - 1), (F.floor((x - first) / step) + 1).cast("int")))


def by_cuts(x: Column, cuts: Sequence[float]) -> Column:
    """Bin of (a, b] intervals: how many cuts are below x."""
    return F.when(x.isNotNull(), sum((F.when(x > c, 1).otherwise(0) for c in cuts), F.lit(0)))


def interval_labels(cuts: Sequence[float]) -> list[str]:
    shown = [f"{c:g}" for c in cuts]
    return [f"<={shown[0]}", *(f"({a}, {b}]" for a, b in zip(shown, shown[1:], strict=False)), f">{shown[-1]}"] if shown else ["all"]


def frequency_cuts(counts: DataFrame, n: int) -> dict[str, list[float]]:
    """Cuts of each attribute into n groups of about equal weight. counts: (attribute, x, w), a row per value.

    A value that fills its group's share ends it: it stays in the group if less than half of its weight is beyond the share (and a value
    follows), else it begins the next one. The first value of all stays. Shares are renewed from what is left. Running totals are made once; each
    round looks up the next such value of all attributes in them, and its neighbours, so that a few rows per attribute reach the driver.
    """
    t = pinned(running(counts, ["x"], {"upto": "w"}, ["attribute"]))
    spark = counts.sparkSession
    heads = {r["attribute"]: r for r in t.groupBy("attribute").agg(F.count("*").alias("k"), F.max("upto").alias("all"), F.min("x").alias("first")).collect()}
    few = [c for c, r in heads.items() if r["k"] <= n]
    cuts: dict[str, list[float]] = {c: [] for c in heads}
    for r in t.where(F.col("attribute").isin(few)).groupBy("attribute").agg(F.sort_array(F.collect_set("x")).alias("xs")).collect() if few else []:
        cuts[r["attribute"]] = [(a + b) / 2 for a, b in zip(r["xs"], r["xs"][1:], strict=False)]
    #: Where each attribute's current group begins: total before it, the value looked at last, and the value before the next one.
    state = {c: (0.0, r["first"], r["first"]) for c, r in heads.items() if r["k"] > n}
    for round_ in range(n - 1):
        goals = [(c, at, base + (heads[c]["all"] - base) / (n - round_)) for c, (base, at, _) in state.items()]
        if not goals:
            break
        goal = F.broadcast(spark.createDataFrame(goals, "attribute string, at double, goal double"))  # a row per attribute
        here = t.join(goal, "attribute").where((F.col("x") > F.col("at")) & (F.col("upto") >= F.col("goal")))
        found = here.groupBy("attribute").agg(F.min_by(F.struct("x", "w", "upto"), "x").alias("v")).select("attribute", "v.*").collect()
        at = F.broadcast(spark.createDataFrame([(r["attribute"], r["x"]) for r in found], "attribute string, at double"))
        beside = t.join(at, "attribute").groupBy("attribute").agg(F.max(F.when(F.col("x") < F.col("at"), F.col("x"))).alias("before"), F.min(F.when(F.col("x") > F.col("at"), F.col("x"))).alias("after"))
        near = {r["attribute"]: (r["before"], r["after"]) for r in beside.collect()}
        ended, state = state, {}
        for r in found:
            c, x, w, upto = r["attribute"], r["x"], r["w"], r["upto"]
            base, _, begun = ended[c]
            before, after = near[c]
            share = (heads[c]["all"] - base) / (n - round_)
            if after is not None and upto - base - share < w / 2:
                cuts[c].append((x + after) / 2)
                state[c] = (upto, x, after)
            else:
                cuts[c].append((max(before, begun) + x) / 2)
                state[c] = (upto - w, x, x)
    return cuts


def _entropy(counts: dict) -> float:
    n = sum(counts.values())
    return -sum(c / n * math.log2(c / n) for c in counts.values() if c > 0) if n else 0.0


def _mdl_cuts(points: list[tuple[float, dict]], force: bool = False) -> list[float]:
    """Recursive entropy cuts accepted by description length; a cut is the value left of it."""
    total: dict = {}
    for _, c in points:
        for y, w in c.items():
            total[y] = total.get(y, 0) + w
    n, whole, best, left = sum(total.values()), _entropy(total), None, {}
    for k in range(len(points) - 1):
        for y, w in points[k][1].items():
            left[y] = left.get(y, 0) + w
        right = {y: total[y] - left.get(y, 0) for y in total}
        nl, nr = sum(left.values()), sum(right.values())
        e = (nl * _entropy(left) + nr * _entropy(right)) / n
        if best is None or e < best[0] - 1e-12:
            best = (e, k, dict(left), right)
    if best is None:
        return []
    e, k, left, right = best
    k0, k1, k2 = (sum(w > 0 for w in d.values()) for d in (total, left, right))
    delta = math.log2(3**k0 - 2) - (k0 * whole - k1 * _entropy(left) - k2 * _entropy(right))
    if whole - e <= (math.log2(max(n - 1, 1)) + delta) / n and not force:
        return []
    return [*_mdl_cuts(points[: k + 1]), points[k][0], *_mdl_cuts(points[k + 1 :])]


def _bimodal(points: list[tuple[float, dict]]) -> list[float]:
    """Two cuts whose middle interval differs most (corrected chi-square) in its classes from the rest."""
    classes = sorted({y for _, c in points for y in c})
    rows = [[c.get(y, 0.0) for y in classes] for _, c in points]
    total = [sum(r[j] for r in rows) for j in range(len(classes))]
    n, best = sum(total), (-1.0, [])
    for i in range(len(rows) - 1):
        mid = [0.0] * len(classes)
        for j in range(i + 1, len(rows) - 1):
            mid = [a + b for a, b in zip(mid, rows[j], strict=True)]
            m = sum(mid)
            chi = sum((max(abs(a - m * t / n) - 0.5, 0.0)) ** 2 / (m * t / n) for a, t in zip(mid, total, strict=True) if t)
            if chi > best[0]:
                best = (chi, [points[i][0], points[j][0]])
    return best[1]


def fit_cuts(df: DataFrame, names: Sequence[str], method: str, n: int = 4, class_name: str | None = None) -> DataFrame:
    """(attribute, cuts) of many columns at once, from counts per distinct value.

    method: frequency, entropy, or bimodal (the last two need a class, and cut each column in a task of its own).
    """
    y = F.col(class_name).cast("string") if class_name else F.lit("")
    long = df.select(y.alias("y"), *(F.col(c).cast("double").alias(c) for c in names)).unpivot("y", list(names), "attribute", "x")
    counts = long.where("x is not null and y is not null").groupBy("attribute", "x", "y").agg(F.count("*").cast("double").alias("w"))

    if method == "frequency":
        cuts = frequency_cuts(counts.groupBy("attribute", "x").agg(F.sum("w").alias("w")), n)
        return df.sparkSession.createDataFrame(list(cuts.items()), "attribute string, cuts array<double>")

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        points = [(x, dict(zip(g["y"], g["w"], strict=True))) for x, g in rows.sort_values("x").groupby("x")]
        cuts = _mdl_cuts(points) if method == "entropy" else _bimodal(points)
        return pd.DataFrame({"attribute": [rows["attribute"].iloc[0]], "cuts": [cuts]})

    return counts.groupBy("attribute").applyInPandas(cut, "attribute string, cuts array<double>")


def cut_rows(cuts: DataFrame) -> DataFrame:
    """(attribute, no, cut): what `fit_cuts` finds, a row per cut, numbered from 1."""
    return cuts.select("attribute", F.posexplode("cuts").alias("no", "cut")).withColumn("no", F.col("no") + 1)


def discretize(df: DataFrame, names: Sequence[str], method: str = "frequency", n: int = 4, class_name: str | None = None, clean: bool = True) -> DataFrame:
    """Replace columns by D_<name> bins; columns left with one bin go if `clean`."""
    cuts = {r["attribute"]: r["cuts"] for r in fit_cuts(df, names, method, n, class_name).collect()}  # a row per column
    for c in names:
        if cuts.get(c) or not clean:
            df = df.withColumn(f"D_{c}", by_cuts(F.col(c), cuts.get(c) or []))
    return df.drop(*names)


def discretize_each(df: DataFrame, cuts: dict[str, Sequence[float]]) -> DataFrame:
    """Columns replaced by D_<name> bins, each by its own cuts."""
    return df.select(*(c for c in df.columns if c not in cuts), *(by_cuts(F.col(c), x).alias(f"D_{c}") for c, x in cuts.items()))


# -- imputation ---------------------------------------------------------------------------


def impute(df: DataFrame, continuous: Sequence[str], discrete: Sequence[str], method: str = "average") -> DataFrame:
    """average (median and mode), minimal, maximal, or mean. The fitted row is one row, joined beside every row."""
    if method == "average":
        fits = [F.median(c).alias(f"_f_{c}") for c in continuous] + [F.mode(c, deterministic=True).alias(f"_f_{c}") for c in discrete]
    else:
        f = {"minimal": F.min, "maximal": F.max, "mean": F.avg}[method]
        fits = [f(c).alias(f"_f_{c}") for c in continuous] + [(F.max if method == "maximal" else F.min)(c).alias(f"_f_{c}") for c in discrete]
    fitted = df.agg(*fits)
    out = df.join(F.broadcast(fitted))
    return out.withColumns({c: F.coalesce(c, f"_f_{c}") for c in [*continuous, *discrete]}).drop(*(f"_f_{c}" for c in [*continuous, *discrete]))


def impute_defaults(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.fillna(values)


def impute_table(df: DataFrame, how: dict[str, str | tuple[str, object]]) -> DataFrame:
    """Each column by its own method: minimal, maximal, mean, median, mode, or ("default", value); one aggregation for all."""
    makers = {"minimal": F.min, "maximal": F.max, "mean": F.avg, "median": F.median, "mode": lambda c: F.mode(c, deterministic=True)}
    fitted = {c: m for c, m in how.items() if isinstance(m, str)}
    if fitted:
        df = df.join(F.broadcast(df.agg(*(makers[m](c).alias(f"_f_{c}") for c, m in fitted.items()))))  # one row
    values = {c: F.col(f"_f_{c}") if c in fitted else F.lit(m[1]) for c, m in how.items()}
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in values.items()}).drop(*(f"_f_{c}" for c in fitted))


def impute_as_value(df: DataFrame, continuous: Sequence[str], discrete: Sequence[str]) -> DataFrame:
    """Unknown as a value NA of its own; continuous columns get an indicator <name>_def and their mean."""
    df = df.withColumns({f"{c}_def": F.when(F.col(c).isNull(), "undef").otherwise("def") for c in continuous} | {c: F.coalesce(c, F.lit("NA")) for c in discrete})
    return impute(df, continuous, [], "mean")


def impute_random(df: DataFrame, continuous: Sequence[str], order: Sequence[str], seed: int = 0) -> DataFrame:
    """Draw from each column's normal distribution, by each row's key."""
    fitted = df.agg(*(f(c).alias(f"_{k}_{c}") for c in continuous for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.join(F.broadcast(fitted))
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}") + F.col(f"_s_{c}") * normal(order, seed + k)) for k, c in enumerate(continuous)}).select(df.columns)


def impute_model(df: DataFrame, target: str, by: Sequence[str]) -> DataFrame:
    """Fill unknown values by a linear model on other columns, whose own unknown values count as their means there and stay unknown in the result.

    Without a row of known target nothing is filled; other columns, whatever their names, pass through.
    """
    from tarnwork.operators.learn import LinearRegression

    means = df.agg(*(F.avg(c).alias(str(k)) for k, c in enumerate(by)), F.count(target).alias("n")).first()
    if not means["n"]:
        return df
    filled = {f"_by{k}": F.coalesce(F.col(c).cast("double"), F.lit(float(means[str(k)] or 0.0))) for k, c in enumerate(by)}
    model = LinearRegression(list(filled), "_y").fit(df.select(F.col(target).alias("_y"), *(x.alias(n) for n, x in filled.items())))
    guess = sum((x * float(b) for x, b in zip(filled.values(), model.coefficients[1:], strict=True)), F.lit(float(model.coefficients[0])))
    return df.withColumn(target, F.coalesce(target, guess))


# -- continuization -------------------------------------------------------------------------


def indicators(name: str, values: Sequence[str], base: str | None = None, zero: float = 0.0) -> list[Column]:
    """One column <name>=<value> per value but the base; unknown stays unknown."""
    x = F.col(name)
    return [F.when(x.isNull(), None).when(x == v, 1.0).otherwise(zero).alias(f"{name}={v}") for v in values if v != base]


def ordinal(name: str, values: Sequence[str], normalized: bool = False) -> Column:
    place = F.array_position(F.array(*map(F.lit, values)), F.col(name))
    index = F.when(place > 0, place - 1).cast("double")
    return (index / max(len(values) - 1, 1) if normalized else index).alias(f"C_{name}")


def normalize(df: DataFrame, names: Sequence[str], by: str = "variance", zero_based: bool = True) -> DataFrame:
    """By variance to mean 0 and deviation 1, by span to [0, 1] or [-1, 1]; unknown becomes 0."""
    if by == "variance":
        pairs = [(F.avg(c), F.stddev_pop(c)) for c in names]
    elif zero_based:
        pairs = [(F.min(c), F.max(c) - F.min(c)) for c in names]
    else:
        pairs = [((F.min(c) + F.max(c)) / 2, (F.max(c) - F.min(c)) / 2) for c in names]
    fitted = df.agg(*(e.alias(f"_{k}_{c}") for c, pair in zip(names, pairs, strict=True) for k, e in zip("as", pair, strict=True)))
    out = df.join(F.broadcast(fitted))
    span = lambda c: F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    return out.withColumns({c: F.coalesce((F.col(c) - F.col(f"_a_{c}")) / span(c), F.lit(0.0)) for c in names}).select(df.columns)


def continuize(df: DataFrame, normal: str = "variance") -> DataFrame:
    """By the domain: discrete features become indicators, continuous ones are normalized; other roles stay."""
    features = domain_of(df).features
    scaled = normalize(df, [v.name for v in features if v.kind == "continuous"], normal)
    discrete = {v.name: v for v in features if v.kind == "discrete"}
    return scaled.select(*(c for n in df.columns for c in (indicators(n, discrete[n].values) if n in discrete else [F.col(n)])))


def jittered(df: DataFrame, names: Sequence[str], order: Sequence[str], amount: float, seed: int = 0) -> DataFrame:
    """Columns moved by up to half of `amount` either way, by each row's key."""
    return df.withColumns({c: F.col(c) + amount * (uniform(order, seed + k) - 0.5) for k, c in enumerate(names)})


def map_values(name: str, mapping: Sequence[int]) -> Column:
    """An index through a list; negative entries and unknown give unknown."""
    found = F.get(F.array(*map(F.lit, mapping)), F.col(name).cast("int"))
    return F.when(found >= 0, found)


# -- noise and weights -------------------------------------------------------------------------


def add_missing(df: DataFrame, proportions: dict[str, float], order: Sequence[str], seed: int = 0) -> DataFrame:
    """Make an exact share of each column unknown, the rows of the smallest hashes of their key."""
    for k, (c, p) in enumerate(proportions.items()):
        df = numbered(df.withColumn("_h", uniform(order, seed + k)), ["_h", *order], "_r")
        total = df.agg(F.count("*").alias("_n"))
        df = df.join(F.broadcast(total)).withColumn(c, F.when(F.col("_r") >= F.floor(F.col("_n") * p + 0.5), F.col(c))).drop("_h", "_r", "_n")
    return df


def add_noise(df: DataFrame, name: str, share: float, values: Sequence[str], order: Sequence[str], seed: int = 0) -> DataFrame:
    """Give an exact share of rows values that are dealt out evenly."""
    df = numbered(df.withColumn("_h", uniform(order, seed)), ["_h", *order], "_r")
    total = df.agg(F.count("*").alias("_n"))
    dealt = F.get(F.array(*map(F.lit, values)), (F.col("_r") % len(values)).cast("int"))
    return df.join(F.broadcast(total)).withColumn(name, F.when(F.col("_r") < F.floor(F.col("_n") * share + 0.5), dealt).otherwise(F.col(name))).drop("_h", "_r", "_n")


def add_gaussian_noise(df: DataFrame, deviations: dict[str, float], order: Sequence[str], seed: int = 0) -> DataFrame:
    """Noise of each column's deviation, by each row's key."""
    return df.withColumns({c: F.col(c) + s * normal(order, seed + k) for k, (c, s) in enumerate(deviations.items())})


def class_weights(df: DataFrame, class_name: str, weights: dict[str, float] | None = None, out: str = "weight") -> DataFrame:
    """Weights N / (k n_c) that make classes equal, times each class's own. Counts per class are few and joined back."""
    counts = df.where(F.col(class_name).isNotNull()).groupBy(F.col(class_name).alias("_c")).agg(F.count("*").alias("_n"))
    counts = counts.select("_c", (F.sum("_n").over(Window.partitionBy(F.lit(0))) / (F.count("*").over(Window.partitionBy(F.lit(0))) * F.col("_n"))).alias(out))
    if weights:
        counts = counts.withColumn(out, F.col(out) * reduce(lambda e, kv: e.when(F.col("_c") == kv[0], kv[1]), weights.items(), F.when(F.lit(False), 1.0)).otherwise(1.0))
    return df.join(counts, F.col(class_name) == F.col("_c"), "left").drop("_c")


def censor_weights_linear(df: DataFrame, event: Column, time: str, max_time: float | None = None, out: str = "weight") -> DataFrame:
    """Events weigh 1, censored rows time / max_time, at most 1."""
    if max_time is not None:
        return df.withColumn(out, F.when(event, 1.0).otherwise(F.least(F.col(time) / max_time, F.lit(1.0))))
    longest = df.agg(F.max(time).alias("_m"))
    return df.join(F.broadcast(longest)).withColumn(out, F.when(event, 1.0).otherwise(F.col(time) / F.col("_m"))).drop("_m")


def lookup(df: DataFrame, keys: Sequence[str], table: dict[tuple, object], out: str) -> DataFrame:
    """A value by one to several discrete columns; no entry, or an unknown key, gives unknown."""
    entries = [F.lit(x) for k, v in table.items() for x in ("\x1f".join(map(str, k)), v)]
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return df.withColumn(out, F.when(known, F.try_element_at(F.create_map(*entries), F.concat_ws("\x1f", *(F.col(k).cast("string") for k in keys)))))


def quantile_cuts(df: DataFrame, name: str, n: int) -> DataFrame:
    return percentiles(df, name, [100 * k / n for k in range(1, n)])
