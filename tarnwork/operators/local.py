"""Local regression (loess): a curve at a bounded number of points over windows that are a share of all rows, or an estimate for each row from its nearest values.

Rows are first summed by distinct values of x. For a curve, the windows' radii are found by narrowing counts of distances, for all points in each pass, and
all fits come from one more aggregation. For rows, distinct values are numbered, dealt to blocks, and those near a block's border go to the
next one too (a halo), so each block has all that its own rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.relational import numbered
from tarnwork.session import pinned

#: A window's last point keeps a little weight.
BEYOND = 1.0000001
#: Parts that a range of distances is cut into.
PARTS = 64


def _each(points: Sequence[float], **also: Sequence[float]) -> Column:
    """A struct (i, p, ...) for each curve point."""
    return F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), *(F.lit(float(v[i])).alias(n) for n, v in also.items())) for i, p in enumerate(points))))


def summed(df: DataFrame, x: str, ys: Sequence[Column]) -> DataFrame:
    """(x, n, s0, s1, ...): known rows by distinct x, with sums of each y. Kept in the shared folder."""
    known = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x"), *(y.cast("double").alias(f"s{k}") for k, y in enumerate(ys))).dropna()
    return pinned(known.groupBy("x").agg(F.count("*").cast("double").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(len(ys)))))


def radii(values: DataFrame, points: Sequence[float], k: float) -> np.ndarray:
    """The distance of each point's kth nearest row."""
    low, high = values.agg(F.min("x"), F.max("x")).first()
    lo, hi = np.zeros(len(points)), np.array([max(abs(low - p), abs(high - p)) for p in points])
    before, open_ = np.zeros(len(points)), set(range(len(points)))
    while open_:
        some = sorted(open_)
        rows = values.select("x", "n", _each([points[i] for i in some], lo=lo[some], hi=hi[some]).alias("_s")).select("n", "_s.i", "_s.lo", "_s.hi", F.abs(F.col("x") - F.col("_s.p")).alias("d"))
        part = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1))).otherwise(0)
        counts = rows.where("d between lo and hi").groupBy("i", part.alias("b")).agg(F.sum("n").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).toPandas().sort_values(["i", "b"])
        for j, own in counts.groupby("i"):
            i = some[j]
            upto = before[i] + own["n"].cumsum().to_numpy()
            at = min(int(np.searchsorted(upto, k)), len(own) - 1)
            before[i] = upto[at] - own["n"].iloc[at]
            lo[i], hi[i] = own["lo"].iloc[at], own["hi"].iloc[at]
            if lo[i] == hi[i]:
                open_.discard(i)
    return hi


def loess_curve(df: DataFrame, x: str, ys: Sequence[Column], points: Sequence[float], window: float = 0.5) -> np.ndarray:
    """[point, y]: local linear fits with tricube weights over the nearest `window` of all rows (3 rows at least), rows as far as the last one included. Rows with an unknown value are left out; without any the curve is unknown."""
    values = summed(df, x, ys)
    n = values.agg(F.sum("n")).first()[0]
    if not n:
        return np.full((len(points), len(ys)), np.nan)
    far = radii(values, points, min(n, max(3, np.ceil(window * n))))
    rows = values.select("*", _each(points, far=far).alias("_s")).select("*", "_s.*").withColumn("u", F.col("x") - F.col("p")).where(F.abs("u") <= F.col("far"))
    near = F.when(F.col("far") > 0, F.abs("u") / (F.col("far") * BEYOND)).otherwise(0.0)
    rows = rows.withColumn("w", F.pow(1 - F.pow(near, 3), 3))
    w, u = F.col("w"), F.col("u")
    sums = [F.sum(w * F.col("n")).alias("w"), F.sum(w * u * F.col("n")).alias("wx"), F.sum(w * u * u * F.col("n")).alias("wxx")]
    sums += [e for k in range(len(ys)) for e in (F.sum(w * F.col(f"s{k}")).alias(f"wy{k}"), F.sum(w * u * F.col(f"s{k}")).alias(f"wxy{k}"))]
    found = rows.groupBy("i").agg(*sums).toPandas().set_index("i").sort_index()
    return np.array([[_at_zero(*found.loc[i, ["w", "wx", "wxx", f"wy{k}", f"wxy{k}"]]) for k in range(len(ys))] for i in range(len(points))])


def _at_zero(w, wx, wxx, wy, wxy):  # noqa: ANN001, ANN202  numbers or arrays
    """The weighted line's height at 0, or the mean where there is only one x."""
    mx, my = wx / w, wy / w
    sxx, sxy = wxx - wx * mx, wxy - wx * my
    # What rounding leaves of no spread is no slope.
    return my - np.where(sxx > 1e-12 * np.maximum(wxx, 1e-300), sxy / np.where(sxx == 0, 1, sxx), 0.0) * mx


def curve_points(df: DataFrame, x: str, n: int = 50) -> list[float]:
    """Points at even distances over a column's span."""
    low, high = df.agg(F.min(F.col(x).cast("double")), F.max(F.col(x).cast("double"))).first()
    return [] if low is None else [low] if low == high else np.linspace(low, high, n).tolist()


def interpolated(x: Column, points: Sequence[float], heights: Sequence[float]) -> Column:
    """A curve between its points; beyond its ends as at them; unknown where x is."""
    ps, hs = (F.array(*(F.lit(float(v)) for v in part)) for part in (points, heights))
    x = x.cast("double")
    i = F.size(F.filter(ps, lambda p: p <= x))
    left, right = F.get(ps, i - 1), F.get(ps, i)
    inside = F.get(hs, i - 1) + (F.get(hs, i) - F.get(hs, i - 1)) * (x - left) / (right - left)
    return F.when(x.isNull(), None).when(i == 0, float(heights[0])).when(i >= len(points), float(heights[-1])).otherwise(inside)


def loess_rows(df: DataFrame, x: str, y: str, k: int, block: int = 50_000) -> DataFrame:
    """(x, estimate) of each distinct x: a local linear fit over its k nearest distinct values (all as far as the kth) with the means of y there, each weighing as many as it has rows."""
    values = numbered(summed(df, x, [F.col(y)]), ["x"], "no")
    size = max(block, 2 * k)
    at, home = F.col("no") % size, F.floor(F.col("no") / size)
    # A value's nearest are at most k places before or after it, so no block needs more than k of its neighbours.
    to = F.array_compact(F.array(home, F.when((at < k) & (home > 0), home - 1), F.when(at >= size - k, home + 1)))
    dealt = values.select("x", "n", "s0", home.alias("home"), F.explode(to).alias("block"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x")
        v, n, s = (rows[c].to_numpy(float) for c in ("x", "n", "s0"))
        own = np.flatnonzero((rows["home"] == rows["block"]).to_numpy())
        out = np.empty(len(own))
        start = max(int(own[0]) - k, 0) if len(own) else 0
        for j, i in enumerate(own):
            while start + k < len(v) and start < i and v[start + k] - v[i] < v[i] - v[start]:
                start += 1
            end = min(start + k, len(v))
            far = max(v[i] - v[start], v[end - 1] - v[i])
            a, b = start, end  # with all that are as far
            while a > 0 and v[i] - v[a - 1] <= far:
                a -= 1
            while b < len(v) and v[b] - v[i] <= far:
                b += 1
            u = v[a:b] - v[i]
            w = (1 - (np.abs(u) / (far * BEYOND)) ** 3) ** 3 if far > 0 else np.ones(b - a)
            wn = w * n[a:b]
            out[j] = _at_zero(wn.sum(), (wn * u).sum(), (wn * u * u).sum(), (w * s[a:b]).sum(), (w * u * s[a:b]).sum())
        return pd.DataFrame({"x": v[own], "estimate": out})

    return dealt.groupBy("block").applyInPandas(fit, "x double, estimate double")


class LoessBayes:
    """Naive Bayes over continuous columns: P(c) * prod P(c | x) / P(c), P(c | x) from loess curves of each class's share. Unknown values have no part in it; rows of an unknown class are left out."""

    def __init__(self, names: Sequence[str], class_name: str, window: float = 0.5, points: int = 50):
        self.names, self.class_name, self.window, self.points = names, class_name, window, points
        self.prior: dict = {}
        self.curves: dict[str, tuple[list[float], np.ndarray]] = {}

    def fit(self, df: DataFrame) -> LoessBayes:
        known = df.where(F.col(self.class_name).isNotNull())
        counts = dict(sorted((r[0], r[1]) for r in known.groupBy(self.class_name).count().collect()))  # classes are few
        self.prior = {c: n / sum(counts.values()) for c, n in counts.items()}
        self.curves = {}
        for name in self.names:
            at = curve_points(known, name, self.points)
            if at:
                self.curves[name] = at, np.clip(loess_curve(known, name, [(F.col(self.class_name) == c).cast("double") for c in self.prior], at, self.window), 1e-6, 1.0)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """With `probability` (in the order of sorted classes) and `prediction`, the first of equals."""
        if not self.prior:
            return df.withColumns({"probability": F.lit(None).cast("array<double>"), "prediction": F.lit(None).cast(df.schema[self.class_name].dataType)})
        total = []
        for k, p in enumerate(self.prior.values()):
            parts = (F.coalesce(interpolated(F.col(c), at, np.log(curve[:, k] / p)), F.lit(0.0)) for c, (at, curve) in self.curves.items())
            total.append(sum(parts, F.lit(float(np.log(p)))))
        own = F.array(*total)
        out = df.withColumn("_s", own).withColumn("_s", F.transform("_s", lambda s: F.exp(s - F.array_max("_s"))))
        out = out.withColumn("probability", F.transform("_s", lambda s: s / F.aggregate("_s", F.lit(0.0), lambda a, b: a + b))).drop("_s")
        best = F.array_position("probability", F.array_max("probability"))
        return out.withColumn("prediction", F.get(F.array(*map(F.lit, self.prior)), (best - 1).cast("int")))
