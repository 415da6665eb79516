"""Kernel machines: classification (C and nu), regression (epsilon and nu) and one-class, with linear, polynomial, RBF and sigmoid kernels.

Blocks of rows are solved by tasks; only rows with weight go on to the next level, where a few blocks' are solved together, until one set is left (a cascade).
Then all rows are held against that model, a pass of tasks; the worst that break its conditions join the set, and it is solved again, until none does:
the solution is that of all rows together, whatever the blocks. What a task or the model holds is bounded by the number of support vectors,
`max_support`, and more are an error. Of the nu kinds a share nu of all rows are support vectors by definition. Rows of equal values and target are one
variable with the sum of their bounds, which is the same problem: such rows count once.

Of more than MOST_HELD different rows too many may have weight. Where a kernel over them is made by few landmarks (in few columns a smooth one is; all rows are
held against that), the same conditions are met without holding any: the primal over the landmarks is solved by Newton steps, each an aggregation over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.relational import spread
from tarnwork.session import pinned

KINDS = ("c_svc", "nu_svc", "one_class", "epsilon_svr", "nu_svr")
#: Rows of a first block; blocks put together at each level.
BLOCK, TOGETHER = 1500, 4
#: Bytes of kernel rows that a solver remembers.
REMEMBERED = 256 << 20
#: Different rows of which blocks' support vectors are always put together; landmarks of a kernel, and rows that they are first looked for among.
MOST_HELD, MOST_RANK, FIRST = 20_000, 400, 4_000
#: Bytes of tasks' sums that come to the driver without being put together first.
MOST_BYTES = 32 << 20


@dataclass(frozen=True)
class Kernel:
    kind: str = "rbf"  # or linear, polynomial, sigmoid
    gamma: float = 0.0  # 0: one over the number of features
    degree: int = 3
    coef0: float = 0.0

    def matrix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        gamma = self.gamma or 1.0 / a.shape[1]
        dots = a @ b.T
        if self.kind == "linear":
            return dots
        if self.kind == "polynomial":
            return (gamma * dots + self.coef0) ** self.degree
        if self.kind == "sigmoid":
            return np.tanh(gamma * dots + self.coef0)
        if self.kind == "rbf":
            return np.exp(-gamma * np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * dots))
        raise ValueError(f"no kernel {self.kind}")

    def diagonal(self, a: np.ndarray) -> np.ndarray:
        return np.array([self.matrix(x[None], x[None])[0, 0] for x in a])

    def own(self, a: np.ndarray) -> np.ndarray:
        """`diagonal`, for many rows and kernels that are inner products."""
        dots = (a * a).sum(1)
        return np.ones(len(a)) if self.kind == "rbf" else dots if self.kind == "linear" else ((self.gamma or 1.0 / a.shape[1]) * dots + self.coef0) ** self.degree


@dataclass
class Problem:
    """Minimize a'Qa / 2 + p'a with 0 <= a <= top, where Q[i, j] = y[i] y[j] K(i, j) and y'a (`apart`: the sum of either sign's a) stays what it is at the start."""

    points: np.ndarray
    of: np.ndarray  # each variable's point
    y: np.ndarray
    p: np.ndarray
    top: np.ndarray
    start: np.ndarray
    apart: bool = False


def solve(problem: Problem, kernel: Kernel, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, gradient): pairs of variables are changed against each other, the one that breaks the conditions most and the one that then gains most."""
    x, of, y, top, a = problem.points, problem.of, problem.y, problem.top, problem.start.astype(float).copy()
    diagonal = kernel.diagonal(x)[of]
    rows: dict[int, np.ndarray] = {}

    def row(k: int) -> np.ndarray:
        if k not in rows:
            if len(rows) * len(x) * 8 > REMEMBERED:
                rows.pop(next(iter(rows)))
            rows[k] = kernel.matrix(x[k : k + 1], x)[0]
        return rows[k]

    weight = np.bincount(of, y * a, len(x))
    used = np.flatnonzero(weight)
    f = sum((kernel.matrix(x, x[part]) @ weight[part] for part in np.array_split(used, -(-len(used) // 1000))), np.zeros(len(x))) if len(used) else np.zeros(len(x))
    g = problem.p + y * f[of]
    parts = [y > 0, y < 0] if problem.apart else [np.ones(len(y), bool)]
    for _ in range(200 * len(y) + 100_000):
        v = -y * g
        up, low = np.where(y > 0, a < top, a > 0), np.where(y > 0, a > 0, a < top)
        gap, i, part = max((_gap(v, up & s, low & s, k) for k, s in enumerate(parts)), key=lambda t: t[0])
        if gap <= tol:
            return a, g
        k_i = row(of[i])[of]
        b = np.where(low & parts[part], v[i] - v, 0.0)
        curve = np.maximum(diagonal[i] + diagonal - 2 * k_i, 1e-12)
        j = int(np.where(b > 0, b * b / curve, -1.0).argmax())
        room = min(top[i] - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else top[j] - a[j])
        free = b[j] / curve[j]
        step = min(free, room)
        for k, sign in ((i, 1), (j, -1)):
            a[k] += sign * y[k] * step
            if a[k] < 1e-12 * top[k]:
                a[k] = 0.0
            elif a[k] > (1 - 1e-12) * top[k]:
                a[k] = top[k]
        g += step * y * (k_i - row(of[j])[of])
    raise RuntimeError("the solver did not converge")


def _gap(v: np.ndarray, up: np.ndarray, low: np.ndarray, part: int) -> tuple[float, int, int]:
    if not up.any() or not low.any():
        return -np.inf, 0, part
    i = int(np.where(up, v, -np.inf).argmax())
    return float(v[i] - np.where(low, v, np.inf).min()), i, part


def _level(v: np.ndarray, a: np.ndarray, y: np.ndarray, top: np.ndarray, some: np.ndarray) -> float:
    """What v is where a is between its bounds, else the middle of what it may be."""
    free = some & (a > 0) & (a < top)
    if free.any():
        return float(v[free].mean())
    up, low = some & np.where(y > 0, a < top, a > 0), some & np.where(y > 0, a > 0, a < top)
    least, most = v[up].max() if up.any() else -np.inf, v[low].min() if low.any() else np.inf
    return float((least + most) / 2) if np.isfinite(least) and np.isfinite(most) else float(least if np.isfinite(least) else most if np.isfinite(most) else 0.0)


def landmarks(x: np.ndarray, kernel: Kernel, left: float, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Points of x, and the inverse of the kernel's Cholesky factor over them, that leave at most `left` of each point's kernel with itself: always the worst next. None if these are more than `most`."""
    rest, g, own = kernel.own(x), np.zeros((len(x), most)), []
    while len(own) <= most:
        worst = int(rest.argmax())
        if rest[worst] <= left:
            factor = g[own, : len(own)]
            return x[own], np.linalg.inv(factor) if own else factor
        if len(own) == most:
            break
        k = len(own)
        g[:, k] = (kernel.matrix(x, x[worst : worst + 1])[:, 0] - g[:, :k] @ g[worst, :k]) / np.sqrt(rest[worst])
        rest = rest - g[:, k] ** 2
        own.append(worst)
        rest[own] = 0.0
    return None


def filled(top: np.ndarray, total: float) -> np.ndarray:
    """From the first on, at their tops until `total` is reached."""
    before = np.cumsum(top) - top
    return np.clip(total - before, 0, top)


@dataclass
class Machine:
    """One dual problem: of two signs, of values, or of one class. `columns` are doubles; `target` holds -1 and 1, or values, or is not used."""

    columns: Sequence[str]
    kind: str = "c_svc"
    kernel: Kernel = field(default_factory=Kernel)
    c: float = 1.0
    nu: float = 0.5
    epsilon: float = 0.1
    tol: float = 1e-3
    weights: tuple[float, float] = (1.0, 1.0)  # of C, for -1 and 1
    max_support: int = 20_000
    support: np.ndarray | None = None
    coefficients: np.ndarray | None = None  # the decision is their sum over kernels with the support vectors, plus the bias
    bias: float = 0.0
    width: float = 0.0  # of the tube around values
    scale: float = 1.0  # what the dual's coefficients were divided by
    rounds: int = 0

    def problem(self, x: np.ndarray, t: np.ndarray, n: float, times: np.ndarray | None = None) -> Problem:
        """The dual of these rows, each there so many times, which stand for n."""
        k = len(x)
        times = np.ones(k) if times is None else times
        once, twice = np.arange(k), np.tile(np.arange(k), 2)
        both = np.concatenate([np.ones(k), -np.ones(k)])
        if self.kind == "c_svc":
            return Problem(x, once, t, -np.ones(k), self.c * times * np.where(t > 0, self.weights[1], self.weights[0]), np.zeros(k))
        if self.kind == "one_class":
            return Problem(x, once, np.ones(k), np.zeros(k), times, filled(times, self.nu * n))
        if self.kind == "nu_svc":
            start = np.zeros(k)
            for s in (-1, 1):
                start[t == s] = filled(times[t == s], self.nu * n / 2)
            return Problem(x, once, t, np.zeros(k), times, start, True)
        top = self.c * times
        if self.kind == "epsilon_svr":
            return Problem(x, twice, both, np.concatenate([self.epsilon - t, self.epsilon + t]), np.tile(top, 2), np.zeros(2 * k))
        return Problem(x, twice, both, np.concatenate([-t, t]), np.tile(top, 2), np.tile(filled(top, self.c * self.nu * n / 2), 2), True)

    def solved(self, x: np.ndarray, t: np.ndarray, n: float, times: np.ndarray | None = None) -> tuple[np.ndarray, float, float, float]:
        """(each row's coefficient, bias, width of the tube, scale)."""
        p = self.problem(x, t, n, times)
        a, g = solve(p, self.kernel, self.tol)
        coefficients = np.bincount(p.of, p.y * a, len(x))
        if not p.apart:
            return coefficients, _level(-p.y * g, a, p.y, p.top, np.ones(len(a), bool)), self.epsilon, 1.0
        plus, minus = (_level(-p.y * g, a, p.y, p.top, p.y == s) * -s for s in (1, -1))
        middle, apart = (plus - minus) / 2, (plus + minus) / 2
        if self.kind == "nu_svc":
            if apart <= 1e-12:
                raise ValueError("the classes can't be told apart with this nu")
            return coefficients / apart, -middle / apart, 0.0, apart
        return coefficients, -middle, -apart, 1.0

    def _of_block(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The rows of a block that have weight, and how many rows the block stands for."""
        n = float(rows.drop_duplicates("_from")["_n"].sum())
        rows = rows.sort_values("_id")
        x, t = rows[list(self.columns)].to_numpy(float), rows["_t"].to_numpy(float)
        if self.kind in ("c_svc", "nu_svc") and len(np.unique(t)) < 2:
            kept = rows.head(1) if self.kind == "c_svc" else rows  # any row may matter yet
        else:
            p = self.problem(x, t, n, rows["_w"].to_numpy(float))
            kept = rows[np.bincount(p.of, solve(p, self.kernel, self.tol)[0], len(x)) > 0]
        return kept.assign(_from=rows["_b"].iloc[0] if len(rows) else 0, _n=n)

    def fit(self, df: DataFrame, target: str | None = None) -> Machine:
        if self.kind not in KINDS:
            raise ValueError(f"no kind {self.kind}")
        known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*self.columns, *([target] if target else [])]))
        rows = df.where(known).select(*(F.col(c).cast("double").alias(c) for c in self.columns), (F.col(target).cast("double") if target else F.lit(1.0)).alias("_t"), F.monotonically_increasing_id().alias("_id"))
        rows = pinned(rows.groupBy(*self.columns, "_t").agg(F.min("_id").alias("_id"), F.count("*").cast("double").alias("_w")))
        plus_w = F.coalesce(F.sum(F.when(F.col("_t") > 0, F.col("_w"))), F.lit(0.0))
        different, n, plus = rows.agg(F.count("*"), F.coalesce(F.sum("_w"), F.lit(0.0)), plus_w).first()
        self.support, self.coefficients, self.bias = np.zeros((0, len(self.columns))), np.zeros(0), 0.0
        if not n:
            return self
        if self.kind == "nu_svc" and self.nu * n / 2 > min(plus, n - plus):
            raise ValueError(f"nu is at most {2 * min(plus, n - plus) / n} for these classes")
        if different > MOST_HELD and self._by_landmarks(rows, n):
            return self
        blocks = -(-different // BLOCK)
        inner = ", ".join(f"`{c}` double" for c in self.columns)
        schema = f"{inner}, _t double, _id long, _w double, _from long, _n double, _b long"
        some = rows.withColumns({"_b": F.pmod(F.xxhash64("_id"), F.lit(blocks)), "_from": F.lit(0).cast("long")})
        some = some.join(F.broadcast(some.groupBy("_b").agg(F.sum("_w").alias("_n"))), "_b").select(*self.columns, "_t", "_id", "_w", "_from", "_n", "_b")
        while blocks > 1:
            some = pinned(some.groupBy("_b").applyInPandas(lambda g: self._of_block(g), schema))
            self._bounded(some.count())
            blocks = -(-blocks // TOGETHER)
            some = some.withColumn("_b", F.floor(F.col("_b") / TOGETHER))
        some = some.select(*self.columns, "_t", "_id", "_w")
        if self.kind in ("nu_svc", "one_class", "nu_svr"):  # a share of all rows must be there to begin with
            n_some, n_plus = some.agg(F.coalesce(F.sum("_w"), F.lit(0.0)), plus_w).first()
            needed = self.nu * n if self.kind == "one_class" else self.nu * n / 2
            if min([n_some] if self.kind != "nu_svc" else [n_plus, n_some - n_plus]) < needed:
                self._bounded(different)
                some = rows
        while True:
            self.rounds += 1
            some = pinned(some.groupBy().applyInPandas(lambda g: self._whole(g, n), f"{inner}, _t double, _id long, _w double, _a double, _bias double, _width double, _scale double"))
            found = some.toPandas()
            self.bias, self.width, self.scale = (float(found[c].iloc[0]) for c in ("_bias", "_width", "_scale"))
            has = found[found["_a"] != 0]
            self._bounded(len(has))
            self.support, self.coefficients = has[list(self.columns)].to_numpy(float), has["_a"].to_numpy(float)
            broken = rows.join(F.broadcast(some.select("_id")), "_id", "left_anti").withColumn("_v", self._violation())
            worst = pinned(broken.where(F.col("_v") * self.scale > 2 * self.tol).orderBy(F.col("_v").desc(), "_id").limit(BLOCK).select(*self.columns, "_t", "_id", "_w"))
            more = worst.count()
            if not more:
                return self
            self._bounded(len(found) + more)
            some = some.select(*self.columns, "_t", "_id", "_w").unionByName(worst)

    def _landmarks(self, rows: DataFrame, left: float) -> tuple[np.ndarray, np.ndarray] | None:
        """`landmarks` that leave at most `left` of any row: what a bounded number of rows need, then what the worst of all rows need besides."""
        names, kernel, most = list(self.columns), self.kernel, min(MOST_RANK, self.max_support)
        some = rows.orderBy(F.xxhash64("_id"), "_id").limit(FIRST).select(*names).toPandas().to_numpy(float)
        while (found := landmarks(some, kernel, left / 2, most)) is not None:
            at, inverse = found

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    x = batch.to_numpy(float)
                    rest = kernel.own(x) - ((kernel.matrix(x, at) @ inverse.T) ** 2).sum(1)
                    yield batch[rest > left].assign(_left=rest[rest > left])

            inner = ", ".join(f"`{c}` double" for c in names)
            worst = rows.select(*names).mapInPandas(run, f"{inner}, _left double").distinct().orderBy(F.col("_left").desc(), *names).limit(BLOCK).toPandas()
            if not len(worst):
                return found
            some = np.concatenate([at, worst[names].to_numpy(float)])
        return None

    def _by_landmarks(self, rows: DataFrame, n: float) -> bool:
        """Finds the machine by Newton steps over landmarks' weights, the bias and the tube's width if nu makes it; False if the kernel has no few landmarks.

        Of nu_svc, whose margin may be as small as `tol`, and of sigmoid kernels, which are no inner products, it finds none.

        A row's part of its bound grows in proportion over a band of `wide` around where the conditions let it: these hold within that, which shrinks down to half of `tol`.
        """
        if self.kind == "nu_svc" or self.kernel.kind == "sigmoid":
            return False
        apart = self.kind == "nu_svr"
        of_all = self.nu * n * (self.c if apart else 1.0)  # of nu_svr and one_class, the sum of all weights
        bound = of_all if self.kind in ("nu_svr", "one_class") else self.c * n * max(self.weights)
        rows = pinned(spread(rows).repartition(*self.columns).sortWithinPartitions(*self.columns))
        scale = max(1e-300, float(rows.agg(F.max(sum((F.col(c) * F.col(c) for c in self.columns), F.lit(0.0)))).first()[0]))
        scale = float(self.kernel.own(np.array([[np.sqrt(scale)] + [0.0] * (len(self.columns) - 1)]))[0])
        left = max(self.tol / 4 / bound, 1e-12 * scale)
        if (found := self._landmarks(rows, left)) is None:
            return False
        at, inverse = found
        r = len(at)
        linear = np.concatenate([np.zeros(r), [of_all if self.kind == "one_class" else 0.0, of_all if apart else 0.0]])
        ridge = np.concatenate([np.ones(r), [0.0, 0.0]])

        def value(sums: dict, w: np.ndarray) -> float:
            return float((ridge * w) @ w / 2 + linear @ w + sums["loss"])

        w, wide = np.zeros(r + 2), max(1.0, self.tol, 4 * (float(rows.agg(F.max(F.abs("_t"))).first()[0]) if self.kind.endswith("svr") else 1.0))
        if not apart:
            ridge[r + 1] = 1.0  # the width stays 0
        while True:
            sums = self._sums(rows, n, at, inverse, w, wide)
            for _ in range(200):
                self.rounds += 1
                slope = ridge * w + linear + sums["slope"]
                curve = np.diag(ridge) + sums["curve"]
                curve[range(r, r + 2), range(r, r + 2)] += 1e-9 * (1 + curve[range(r, r + 2), range(r, r + 2)])
                step = -np.linalg.solve(curve, slope)
                gain = float(-slope @ step)
                if wide > self.tol / 2 and gain <= 1e-6 * (1 + abs(value(sums, w))):  # good enough to go on from
                    break
                if gain <= 1e-10 * (1 + abs(value(sums, w))) and np.abs(slope[:r]).max(initial=0) <= self.tol / 10 and np.abs(slope[r:]).max() <= 1e-6 * (1 + sums["all"]):
                    break
                share = min(1.0, 8 * wide / max(np.abs(step[r:]).sum(), 1e-300))  # no farther than the curve, which few rows in the band may make, is known
                ahead = self._sums(rows, n, at, inverse, w + share * step, wide)
                for _ in range(40):
                    if value(ahead, w + share * step) <= value(sums, w) - 1e-4 * share * gain + 1e-12 * abs(value(sums, w)):
                        break
                    share /= 2
                    ahead = self._sums(rows, n, at, inverse, w + share * step, wide)
                w, sums = w + share * step, ahead
            else:
                raise RuntimeError("the solver did not converge")
            if wide <= self.tol / 2:
                break
            wide = max(wide / 4, self.tol / 2)
        if sums["all"] * left > self.tol / 2:
            return False
        self.support, self.coefficients, self.bias = at, inverse.T @ w[:r], float(w[r])
        self.width = float(w[r + 1]) if apart else self.epsilon if self.kind == "epsilon_svr" else 0.0
        return True

    def _sums(self, rows: DataFrame, n: float, at: np.ndarray, inverse: np.ndarray, w: np.ndarray, wide: float) -> dict:
        """Over all rows: the loss, its slope and curve by w (landmarks' weights, bias, width), and the sum of what rows have of their bounds."""
        names, r = list(self.columns), len(at)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, every, slope, curve = 0.0, 0.0, np.zeros(r + 2), np.zeros((r + 2, r + 2))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.column_stack([batch.column(c).to_numpy() for c in names])
                own = np.concatenate([[True], (x[1:] != x[:-1]).any(1)])  # equal points are neighbours
                point, x = np.cumsum(own) - 1, x[own]
                p = self.problem(point, batch.column("_t").to_numpy(), n, batch.column("_w").to_numpy())
                of, phi = point[p.of], self.kernel.matrix(x, at) @ inverse.T
                u = -p.p - p.y * (phi @ w[:r] + w[r])[of] - w[r + 1]
                share = np.clip(u / wide + 0.5, 0, 1)
                loss += float((p.top * np.where(share < 1, wide / 2 * share * share, u)).sum())
                a, bend = p.top * share, p.top / wide * ((share > 0) & (share < 1))
                every += float(a.sum())
                slope -= np.concatenate([np.bincount(of, a * p.y, len(x)) @ phi, [(a * p.y).sum(), a.sum()]])
                here = np.bincount(of, bend, len(x))
                some = here > 0
                curve[:r, :r] += (phi[some].T * here[some]) @ phi[some]
                curve[:r, r] += here @ phi
                curve[:r, r + 1] += np.bincount(of, bend * p.y, len(x)) @ phi
                curve[r, r] += bend.sum()
                curve[r, r + 1] += (bend * p.y).sum()
                curve[r + 1, r + 1] += bend.sum()
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[loss, every], slope, curve.ravel()]).tobytes()], pa.binary())], names=["sums"])

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = sum((np.frombuffer(v.as_py()) for batch in batches for v in batch.column(0)), np.zeros(2 + r + 2 + (r + 2) ** 2))
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

        parts = rows.select(*names, "_t", "_w").mapInArrow(run, "sums binary")
        few = rows.rdd.getNumPartitions() * (r + 4) ** 2 * 8 <= MOST_BYTES
        out = sum(np.frombuffer(v[0]) for v in (parts if few else parts.repartition(1).mapInArrow(total, "sums binary")).collect())
        curve = out[r + 4 :].reshape(r + 2, r + 2)
        upper = np.triu(curve, 1)
        upper[:r, :r] = 0
        slope, curve = out[2 : r + 4].copy(), curve + upper.T
        if self.kind != "nu_svr":
            slope[r + 1] = curve[r + 1] = curve[:, r + 1] = 0
        return {"loss": out[0], "all": out[1], "slope": slope, "curve": curve}

    def _bounded(self, n: int) -> None:
        if n > self.max_support:
            raise ValueError(f"more than {self.max_support} rows have or may have weight: {n}")

    def _whole(self, rows: pd.DataFrame, n: float) -> pd.DataFrame:
        rows = rows.sort_values("_id")
        a, bias, width, scale = self.solved(rows[list(self.columns)].to_numpy(float), rows["_t"].to_numpy(float), float(n), rows["_w"].to_numpy(float))
        return rows.assign(_a=a, _bias=bias, _width=width, _scale=scale)

    def decision(self) -> Column:
        """Above 0 for the class of 1 or inside, or the value; unknown where a column is."""
        support, coefficients, bias, kernel = self.support, self.coefficients, self.bias, self.kernel

        @F.pandas_udf("double")
        def value(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float, na_value=np.nan) for c in columns])
            out = np.full(len(x), bias)
            for at in range(0, len(x), 1000):
                out[at : at + 1000] += kernel.matrix(x[at : at + 1000], support) @ coefficients if len(support) else 0.0
            out[np.isnan(x).any(1)] = np.nan
            return pd.Series(out)

        d = value(*(F.col(c).cast("double") for c in self.columns))
        return F.when(~F.isnan(d), d)

    def _violation(self) -> Column:
        """How far a row without weight is from what its lack of weight demands."""
        d = self.decision()
        if self.kind in ("c_svc", "nu_svc"):
            return 1 - F.col("_t") * d
        return -d if self.kind == "one_class" else F.abs(F.col("_t") - d) - self.width


@dataclass
class SVM:
    """A machine over a table's columns, each put on [0, 1] by its span if `normalize`: for several classes one for each two, which vote.

    Rows with unknown values are left out of the fit and get no prediction. A table of one class predicts it; an empty one predicts nothing.
    """

    names: Sequence[str]
    target: str | None = None
    kind: str = "c_svc"
    kernel: Kernel = field(default_factory=Kernel)
    normalize: bool = True
    options: dict = field(default_factory=dict)  # of Machine: c, nu, epsilon, tol, max_support
    class_weights: dict = field(default_factory=dict)
    classes: list | None = None
    machines: dict | None = None
    spans: dict | None = None

    def _scaled(self, df: DataFrame) -> DataFrame:
        scale = lambda c: (F.col(c) - self.spans[c][0]) / self.spans[c][1]
        return df.withColumns({f"_x{k}": scale(c) for k, c in enumerate(self.names)})

    def fit(self, df: DataFrame) -> SVM:
        row = df.agg(*(f(c).cast("double").alias(f"{k}{i}") for i, c in enumerate(self.names) for k, f in (("lo", F.min), ("hi", F.max)))).first()
        ends = {c: ((row[f"lo{i}"] or 0.0), (row[f"hi{i}"] or 0.0)) for i, c in enumerate(self.names)}
        self.spans = {c: (lo, hi - lo or 1.0) if self.normalize else (0.0, 1.0) for c, (lo, hi) in ends.items()}
        x = self._scaled(df)
        columns = [f"_x{k}" for k in range(len(self.names))]
        make = lambda **o: Machine(columns, self.kind, self.kernel, **self.options | o)
        if self.kind not in ("c_svc", "nu_svc"):
            self.machines = {None: make().fit(x, None if self.kind == "one_class" else self.target)}
            return self
        self.classes = sorted(r[0] for r in df.where(F.col(self.target).isNotNull()).select(self.target).distinct().collect())  # classes are few
        self.machines = {}
        for i, a in enumerate(self.classes):
            for b in self.classes[i + 1 :]:
                two = x.where(F.col(self.target).isin(a, b)).withColumn("_sign", F.when(F.col(self.target) == b, 1.0).otherwise(-1.0))
                self.machines[a, b] = make(weights=(self.class_weights.get(a, 1.0), self.class_weights.get(b, 1.0))).fit(two, "_sign")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """With `prediction` (the class, the value, or whether the row is inside), and `decision` where there is one machine."""
        x = self._scaled(df)
        extra = [f"_x{k}" for k in range(len(self.names))]
        if self.classes is None:
            d = x.withColumn("decision", self.machines[None].decision())
            return d.withColumn("prediction", F.col("decision") >= 0 if self.kind == "one_class" else F.col("decision")).drop(*extra)
        kind = df.schema[self.target].dataType if self.target in df.columns else "string"
        if len(self.classes) < 2:
            known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in self.names))
            return df.withColumn("prediction", F.when(known, F.lit(self.classes[0] if self.classes else None)).cast(kind))
        each = {f"_d{k}": m.decision() for k, m in enumerate(self.machines.values())}
        x = x.withColumns(each)
        votes = [sum((F.when((F.col(f"_d{k}") > 0) == (c == b), 1).otherwise(0) for k, (a, b) in enumerate(self.machines) if c in (a, b)), F.lit(0)) for c in self.classes]
        best = reduce(lambda e, k: e.when(votes[k] == F.greatest(*votes), F.lit(self.classes[k])), range(1, len(votes)), F.when(votes[0] == F.greatest(*votes), F.lit(self.classes[0])))
        out = x.withColumn("prediction", F.when(F.col("_d0").isNotNull(), best).cast(kind))
        return (out.withColumn("decision", F.col("_d0")) if len(each) == 1 else out).drop(*extra, *each)
