"""Learners: fit(df) -> model, model.transform(df) adds prediction (and probability). Sufficient statistics come from aggregations; the rest from pyspark.ml."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.operators.aggregate import domain_contingency
from tarnwork.operators.distance import MOST_SENT, dealt
from tarnwork.operators.relational import checked_broadcast
from tarnwork.session import pinned

#: Kinds of ids whose shares are looked up in a row of each id.
MOST_KINDS = 100


def majority(df: DataFrame, class_name: str) -> DataFrame:
    """One row: the most frequent class (lowest of equals) and its share."""
    c = df.where(F.col(class_name).isNotNull()).groupBy(class_name).agg(F.count("*").alias("n"))
    return c.agg(F.min_by(class_name, F.struct(-F.col("n"), F.col(class_name))).alias("prediction"), (F.max("n") / F.sum("n")).alias("share"))


def mean_learner(df: DataFrame, class_name: str) -> DataFrame:
    return df.agg(F.avg(class_name).alias("prediction"))


def least_cost(df: DataFrame, probabilities: dict[str, Column], cost: dict[tuple[str, str], float]) -> Column:
    """The class of least expected cost; cost[predicted, actual]."""
    options = [F.struct(sum((p * cost.get((c, a), 0.0) for a, p in probabilities.items()), F.lit(0.0)).alias("cost"), F.lit(c).alias("c")) for c in probabilities]
    return F.array_min(F.array(*options))["c"]


@dataclass
class NaiveBayes:
    """P(c) * prod P(c | a) / P(c) over known discrete values, with m-estimates; a table per attribute, applied as map lookups."""

    names: Sequence[str]
    class_name: str
    m: float = 2.0
    classes: list[str] | None = None
    prior: dict | None = None
    tables: dict | None = None

    def fit(self, df: DataFrame) -> NaiveBayes:
        rows = domain_contingency(df.where(F.col(self.class_name).isNotNull()), self.names, self.class_name).collect()  # values by classes: bounded
        totals: dict = {}
        for r in rows:
            if r["attribute"] == self.names[0]:
                totals[r["class"]] = totals.get(r["class"], 0.0) + r["weight"]
        n = sum(totals.values())
        self.classes = sorted(totals)
        self.prior = {c: totals[c] / n for c in self.classes}
        self.tables = {}
        for r in rows:
            if r["value"] is not None:
                self.tables.setdefault((r["attribute"], r["value"]), {})[r["class"]] = r["weight"]
        return self

    def _score(self, c: str) -> Column:
        total = F.lit(float(np.log(self.prior[c])))
        for a in self.names:
            entries = []
            for (attribute, value), counts in self.tables.items():
                if attribute == a:
                    p = (counts.get(c, 0.0) + self.m * self.prior[c]) / (sum(counts.values()) + self.m)
                    entries += [F.lit(value), F.lit(float(np.log(max(p / self.prior[c], 1e-300))))]
            total = total + F.coalesce(F.try_element_at(F.create_map(*entries), F.col(a).cast("string")), F.lit(0.0))
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        df = df.withColumn("_s", F.array(*(self._score(c) for c in self.classes)))
        e = F.transform("_s", lambda s: F.exp(s - F.array_max("_s")))
        df = df.withColumn("_e", e).withColumn("probability", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)))
        best = F.array_position("probability", F.array_max("probability"))
        return df.withColumn("prediction", F.get(F.array(*map(F.lit, self.classes)), (best - 1).cast("int"))).drop("_s", "_e")


def knn_predict(neighbours: DataFrame, labels: DataFrame, key: str, class_name: str) -> DataFrame:
    """(probe, prediction) by votes weighted exp(-d^2 / s^2), s^2 = d_k^2 / -ln 0.001. neighbours: (probe, neighbour, d, rank)."""
    far = Window.partitionBy("probe")
    n = neighbours.withColumn("_f", F.max("d").over(far))
    w = F.when(F.col("_f") > 0, F.exp(F.col("d") * F.col("d") * float(np.log(0.001)) / (F.col("_f") * F.col("_f")))).otherwise(1.0)
    votes = n.withColumn("w", w).join(labels.select(F.col(key).alias("neighbour"), F.col(class_name).alias("c")), "neighbour").groupBy("probe", "c").agg(F.sum("w").alias("v"))
    return votes.groupBy("probe").agg(F.min_by("c", F.struct(-F.round("v", 9), F.col("c"))).alias("prediction"))


@dataclass
class LinearRegression:
    """Least squares, with a ridge if asked: the Gram matrix by one aggregation, a small solve on the driver."""

    names: Sequence[str]
    target: str
    ridge: float = 0.0
    coefficients: np.ndarray | None = None
    statistics: dict | None = None

    def fit(self, df: DataFrame) -> LinearRegression:
        cols = [F.lit(1.0), *(F.col(c).cast("double") for c in self.names), F.col(self.target).cast("double")]
        known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*self.names, self.target]))
        k = len(cols)
        sums = df.where(known).agg(*(F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k))).first()
        g = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        xx, xy, yy, n = g[:-1, :-1], g[:-1, -1], g[-1, -1], g[0, 0]
        inverse = np.linalg.pinv(xx + self.ridge * np.diag([0.0] + [1.0] * (k - 2)))
        self.coefficients = inverse @ xy
        sse = yy - 2 * self.coefficients @ xy + self.coefficients @ xx @ self.coefficients
        sst = yy - g[0, -1] ** 2 / max(n, 1)
        free = max(n - k + 1, 1)
        se = np.sqrt(np.maximum(np.diag(inverse) * sse / free, 0))
        r2 = 1 - sse / sst if sst else 0.0
        self.statistics = {"r2": r2, "r2_adjusted": 1 - (1 - r2) * (n - 1) / free, "f": (r2 / max(k - 2, 1)) / max((1 - r2) / free, 1e-300), "se": se, "t": self.coefficients / np.maximum(se, 1e-300), "n": n}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        terms = (F.col(c) * float(b) for c, b in zip(self.names, self.coefficients[1:], strict=True))
        return df.withColumn("prediction", sum(terms, F.lit(float(self.coefficients[0]))))


@dataclass
class Logistic:
    """Logistic regression of a 0/1 class by Newton's steps, with standard errors; each step is one aggregation, and a small solve on the driver."""

    names: Sequence[str]
    target: str
    ridge: float = 0.0
    coefficients: np.ndarray | None = None
    statistics: dict | None = None

    def _linear(self) -> Column:
        return sum((F.col(c) * float(b) for c, b in zip(self.names, self.coefficients[1:], strict=True)), F.lit(float(self.coefficients[0])))

    def fit(self, df: DataFrame) -> Logistic:
        known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*self.names, self.target]))
        rows = df.where(known).select(*(F.col(c).cast("double").alias(c) for c in self.names), F.col(self.target).cast("double").alias("_y"))
        k = len(self.names) + 1
        self.coefficients, before = np.zeros(k), -np.inf
        penalty = self.ridge * np.diag([0.0] + [1.0] * (k - 1))
        for _ in range(50):
            z, x = self._linear(), [F.lit(1.0), *(F.col(c) for c in self.names)]
            p = 1 / (1 + F.exp(-z))
            fit = F.col("_y") * z - F.when(z > 0, z + F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z)))
            sums = rows.agg(F.sum(fit).alias("fit"), *(F.sum(x[i] * (F.col("_y") - p)).alias(f"g{i}") for i in range(k)), *(F.sum(p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k))).first()
            if sums["fit"] is None:
                return self
            h = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + penalty
            inverse = np.linalg.pinv(h)
            likelihood = sums["fit"] - 0.5 * self.coefficients @ penalty @ self.coefficients
            se = np.sqrt(np.maximum(np.diag(inverse), 0))
            wald = self.coefficients / np.maximum(se, 1e-300)
            self.statistics = {"se": se, "z": wald, "p": np.array([math.erfc(abs(v) / math.sqrt(2)) for v in wald]), "likelihood": sums["fit"]}
            if abs(likelihood - before) < 1e-9 * (1 + abs(likelihood)):
                break
            before = likelihood
            self.coefficients = self.coefficients + inverse @ (np.array([sums[f"g{i}"] for i in range(k)]) - penalty @ self.coefficients)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        p = 1 / (1 + F.exp(-self._linear()))
        return df.withColumn("p", p).withColumn("prediction", (F.col("p") >= 0.5).cast("double"))


def stepwise_logistic(df: DataFrame, names: Sequence[str], target: str, add: float = 0.2, remove: float = 0.3) -> list[str]:
    """Columns whose addition raises the likelihood with p below `add`, most first; one whose removal has p above `remove` goes again."""

    def likelihood(chosen: list[str]) -> float:
        return Logistic(chosen, target).fit(df).statistics["likelihood"]

    chance = lambda less, more: math.erfc(math.sqrt(max(more - less, 0.0)))  # noqa: E731  of twice the difference as chi-square with one degree
    chosen: list[str] = []
    now = likelihood(chosen)
    while True:
        found = [(likelihood([*chosen, c]), c) for c in names if c not in chosen]
        if not found or chance(now, max(found)[0]) >= add:
            return chosen
        now, best = max(found)
        chosen.append(best)
        for c in chosen[:-1]:
            less = likelihood([x for x in chosen if x != c])
            if chance(less, now) > remove:
                chosen.remove(c)
                now = less


def fisher(df: DataFrame, names: Sequence[str], class_name: str, k: int) -> tuple[np.ndarray, DataFrame]:
    """(directions, projected rows): those that part the classes' means most, relative to the spread inside; one aggregation per class."""
    n = len(names)
    rows = df.where(F.col(class_name).isNotNull()).groupBy(class_name).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(names)), *(F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n))).collect()
    weight = np.array([r["n"] for r in rows], float) / sum(r["n"] for r in rows)
    means = np.array([[r[f"m{i}"] for i in range(n)] for r in rows])
    inside = sum(w * np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) for w, r in zip(weight, rows, strict=True))
    apart = (means - weight @ means).T @ ((means - weight @ means) * weight[:, None])
    values, vectors = np.linalg.eigh(inside)
    root = vectors / np.sqrt(np.maximum(values, 1e-12))  # columns scale the inside to one
    inner, turned = np.linalg.eigh(root.T @ apart @ root)
    parts = (root @ turned[:, np.argsort(-inner)[:k]]).T
    parts = parts * np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(1)])[:, None]
    return parts, df.withColumns({f"fd{i + 1}": sum((F.col(c) * float(b) for c, b in zip(names, p, strict=True)), F.lit(0.0)) for i, p in enumerate(parts)})


@dataclass
class Lasso:
    """FISTA on standardized columns, penalty lambda n / (2 m); needs the Gram matrix only."""

    names: Sequence[str]
    target: str
    penalty: float = 0.1
    coefficients: np.ndarray | None = None

    def fit(self, df: DataFrame) -> Lasso:
        k = len(self.names)
        row = df.agg(F.count("*").alias("n"), *(f(c).alias(f"{i}{j}") for j, c in enumerate([*self.names, self.target]) for i, f in (("m", F.avg), ("s", F.stddev_pop))), *(F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate([*self.names, self.target]) for j, b in enumerate([*self.names, self.target]))).first()
        s = np.array([row[f"s{j}"] or 1.0 for j in range(k + 1)])
        c = np.array([[row[f"c{i}_{j}"] for j in range(k + 1)] for i in range(k + 1)]) / np.outer(s, s) * row["n"]
        xx, xy = c[:k, :k], c[:k, k]
        step = 1 / max(np.linalg.eigvalsh(xx).max(), 1e-12)
        lam = 0.5 * self.penalty * row["n"] / k
        w, z, t = np.zeros(k), np.zeros(k), 1.0
        for _ in range(2000):
            g = z - step * (xx @ z - xy)
            new = np.sign(g) * np.maximum(np.abs(g) - step * lam, 0)
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            z, w, t, moved = new + (t - 1) / t2 * (new - w), new, t2, np.abs(new - w).max()
            if moved < 1e-9:
                break
        b = w * s[k] / s[:k]
        self.coefficients = np.concatenate([[row[f"m{k}"] - sum(b[j] * row[f"m{j}"] for j in range(k))], b])
        return self

    transform = LinearRegression.transform


def pls(df: DataFrame, names: Sequence[str], targets: Sequence[str], parts: int) -> np.ndarray:
    """PLS coefficients (features by targets, on centered columns) by NIPALS over cross products only."""
    every = [*names, *targets]
    row = df.agg(F.count("*").alias("n"), *(F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(every) for j, b in enumerate(every))).first()
    c = np.array([[row[f"c{i}_{j}"] for j in range(len(every))] for i in range(len(every))])
    k = len(names)
    xx, xy = c[:k, :k].copy(), c[:k, k:].copy()
    r, p, q = [], [], []
    proj = np.eye(k)
    for _ in range(parts):
        u, _, _ = np.linalg.svd(proj @ xy)
        w = proj @ u[:, 0]
        tt = w @ xx @ w
        if tt < 1e-12:
            break
        load = xx @ w / tt
        r.append(w)
        p.append(load)
        q.append(xy.T @ w / tt)
        proj = proj - np.outer(w, load) @ proj
        xy = xy - np.outer(load, q[-1]) * tt
    return np.array(r).T @ np.array(q) if r else np.zeros((k, len(targets)))


# -- trees and rules: grown on the driver over aggregated statistics of all open nodes at once --------


@dataclass
class Tree:
    """A binary decision tree over continuous (binned by quantiles) and discrete columns: one aggregation per level for all nodes."""

    continuous: Sequence[str]
    discrete: Sequence[str]
    class_name: str
    depth: int = 5
    min_rows: int = 20
    bins: int = 32
    nodes: dict | None = None

    def fit(self, df: DataFrame) -> Tree:
        row = df.agg(*(F.percentile_approx(c, [k / self.bins for k in range(1, self.bins)], 1000).alias(c) for c in self.continuous)).first() if self.continuous else {}
        tests = [(c, v) for c in self.continuous for v in sorted(set(row[c] or []))]
        values = df.agg(*(F.collect_set(F.col(c).cast("string")).alias(c) for c in self.discrete)).first() if self.discrete else {}
        tests += [(c, v) for c in self.discrete for v in sorted(values[c])]
        self.nodes = {1: None}
        open_ = [1]
        for level in range(self.depth + 1):
            at = df.withColumn("_n", self._node()).where(F.col("_n").isin(*open_))
            yes = [F.count_if(self._test(t)).alias(f"t{k}") for k, t in enumerate(tests)]
            rows = at.groupBy("_n", F.col(self.class_name).cast("string").alias("_y")).agg(F.count("*").alias("_all"), *yes).collect()
            found: dict = {}
            for r in rows:
                found.setdefault(r["_n"], []).append(r)
            grown = []
            for node, part in found.items():
                n = np.array([r["_all"] for r in part], float)
                label = part[int(n.argmax())]["_y"]
                self.nodes[node] = ("leaf", label, dict(zip((r["_y"] for r in part), (n / n.sum()).tolist(), strict=True)))
                if level == self.depth or n.sum() < 2 * self.min_rows or (n > 0).sum() < 2:
                    continue
                y = np.array([[r[f"t{k}"] for k in range(len(tests))] for r in part], float)
                gain = self._entropy(n[:, None])[0] - (y.sum(0) * self._entropy(y) + (n[:, None] - y).sum(0) * self._entropy(n[:, None] - y)) / n.sum()
                gain[(y.sum(0) < self.min_rows) | (n.sum() - y.sum(0) < self.min_rows)] = -1
                best = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[best] > 1e-9:
                    self.nodes[node] = ("split", tests[best], self.nodes[node])
                    grown += [2 * node, 2 * node + 1]
            for g in grown:
                self.nodes[g] = None
            open_ = grown
            if not open_:
                break
        return self

    @staticmethod
    def _entropy(counts: np.ndarray) -> np.ndarray:
        p = counts / np.maximum(counts.sum(0), 1e-12)
        return -(p * np.log2(np.maximum(p, 1e-12))).sum(0)

    def _test(self, test: tuple) -> Column:
        name, value = test
        return F.coalesce(F.col(name) <= value if name in self.continuous else F.col(name) == value, F.lit(False))

    def _node(self, node: int = 1) -> Column:
        here = self.nodes.get(node)
        if here is None or here[0] == "leaf":
            return F.lit(node)
        return F.when(self._test(here[1]), self._node(2 * node)).otherwise(self._node(2 * node + 1))

    def transform(self, df: DataFrame) -> DataFrame:
        """The tree as one CASE expression."""
        def label(node: int) -> Column:
            here = self.nodes[node]
            if here is None:  # the table was empty
                return F.lit(None).cast("string")
            return F.lit(here[1]) if here[0] == "leaf" else F.when(self._test(here[1]), label(2 * node)).otherwise(label(2 * node + 1))

        return df.withColumn("prediction", label(1))

    def dump(self, node: int = 1, indent: int = 0) -> str:
        here = self.nodes[node]
        if here is None:
            return " " * indent + "-> ?\n"
        if here[0] == "leaf":
            return " " * indent + f"-> {here[1]}\n"
        name, value = here[1]
        sign = ("<=", ">") if name in self.continuous else ("=", "<>")
        return "".join(" " * indent + f"{name} {s} {value}\n" + self.dump(2 * node + k, indent + 2) for k, s in enumerate(sign))


def apply_rules(df: DataFrame, rules: Sequence[tuple[Column, str]], default: str) -> DataFrame:
    """The first rule that covers a row."""
    first = reduce(lambda e, r: e.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1])) if rules else F.lit(default)
    return df.withColumn("prediction", first.otherwise(default) if rules else first)


def learn_rules(df: DataFrame, names: Sequence[str], class_name: str, target: str, beam: int = 5, length: int = 5) -> list[tuple[list[tuple[str, str]], float]]:
    """Unordered rules for a class by beam search, until none is more often right than wrong; every round's candidates are counted in one aggregation; covered positives are taken away."""
    vals = df.agg(*(F.collect_set(F.col(c).cast("string")).alias(c) for c in names)).first()
    selectors = [(c, v) for c in names for v in sorted(vals[c])]
    cond = lambda r: reduce(lambda a, b: a & b, (F.col(c) == v for c, v in r), F.lit(True))
    out: list[tuple[list[tuple[str, str]], float]] = []
    pos = F.col(class_name) == target
    while True:
        covered = reduce(lambda a, b: a | b, (cond(r) for r, _ in out), F.lit(False))
        left = df.where(~(F.coalesce(covered, F.lit(False)) & pos))
        front, best = [[]], ([], -1.0)
        for _ in range(length):
            cands = [r + [s] for r in front for s in selectors if s[0] not in {c for c, _ in r}]
            if not cands:
                break
            row = left.agg(*(F.count_if(cond(r) & pos).alias(f"p{k}") for k, r in enumerate(cands)), *(F.count_if(cond(r)).alias(f"n{k}") for k, r in enumerate(cands))).first()
            scored = sorted(((r, (row[f"p{k}"] + 1) / (row[f"n{k}"] + 2)) for k, r in enumerate(cands) if row[f"p{k}"] > 0), key=lambda x: (-x[1], x[0]))
            front = [r for r, _ in scored[:beam]]
            if scored and scored[0][1] > best[1]:
                best = scored[0]
        if not best[0] or best[1] <= 0.5:
            break
        out.append(best)
    return out


# -- models of pyspark.ml, with the library's column conventions -----------------------------------


def assembled(df: DataFrame, names: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="skip").transform(df)


def ml(kind: str, names: Sequence[str], label: str, **options: object) -> Callable[[DataFrame], Callable[[DataFrame], DataFrame]]:
    """fit(train) -> (rows -> rows with predictions), for logistic, svm, neural, forest, forest_regression, boosted, tree, tree_regression, kmeans, mixture."""
    from pyspark.ml import classification, clustering, regression

    makers = {
        "logistic": classification.LogisticRegression, "svm": classification.LinearSVC, "neural": classification.MultilayerPerceptronClassifier, "forest": classification.RandomForestClassifier,
        "forest_regression": regression.RandomForestRegressor, "boosted": classification.GBTClassifier, "tree": classification.DecisionTreeClassifier, "tree_regression": regression.DecisionTreeRegressor,
        "kmeans": clustering.KMeans, "mixture": clustering.GaussianMixture,
    }

    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        model = makers[kind](featuresCol="features", **({} if kind in ("kmeans", "mixture") else {"labelCol": label}), **options).fit(assembled(train, names))
        return lambda rows: model.transform(assembled(rows, names))

    return fit


def bagging(fit: Callable, df: DataFrame, order: Sequence[str], t: int = 5, seed: int = 0) -> Callable[[DataFrame, str], DataFrame]:
    """t models on bootstrap samples; their votes' mode."""
    from tarnwork.operators.sampling import bootstrap

    models = [fit(bootstrap(df, order, seed + k).drop("replica")) for k in range(t)]

    def vote(rows: DataFrame, key: str) -> DataFrame:
        every = reduce(lambda a, b: a.unionByName(b), (m(rows).select(key, "prediction") for m in models))
        return every.groupBy(key).agg(F.mode("prediction", deterministic=True).alias("prediction"))

    return vote


def boost(df: DataFrame, names: Sequence[str], label: str, rounds: int = 3, depth: int = 1) -> Callable[[DataFrame], DataFrame]:
    """AdaBoost.M1 with weighted trees of pyspark.ml; stops at no error or at 0.499."""
    from pyspark.ml.classification import DecisionTreeClassifier

    x = assembled(df, names).withColumn("_w", F.lit(1.0))
    models = []
    for _ in range(rounds):
        model = DecisionTreeClassifier(labelCol=label, weightCol="_w", maxDepth=depth).fit(x)
        out = model.transform(x)
        wrong, total = out.agg(F.sum(F.when(F.col("prediction") != F.col(label), F.col("_w")).otherwise(0.0)), F.sum("_w")).first()
        e = wrong / total
        if e >= 0.499:
            break
        models.append((model, float(np.log((1 - e) / max(e, 1e-9)))))
        if e == 0:
            break
        x = out.withColumn("_w", F.when(F.col("prediction") == F.col(label), F.col("_w") * e / (1 - e)).otherwise(F.col("_w"))).drop("prediction", "rawPrediction", "probability").checkpoint()

    def predict(rows: DataFrame) -> DataFrame:
        rows = assembled(rows, names)
        for k, (m, _) in enumerate(models):
            rows = m.transform(rows).withColumn(f"_p{k}", F.col("prediction")).drop("prediction", "rawPrediction", "probability")
        score = sum((F.when(F.col(f"_p{k}") == 1, a).otherwise(-a) for k, (_, a) in enumerate(models)), F.lit(0.0))
        return rows.withColumn("prediction", (score > 0).cast("double")).drop(*(f"_p{k}" for k in range(len(models))))

    return predict


def pca(df: DataFrame, names: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """(components, variances, projected rows): the covariance by one aggregation."""
    n = len(names)
    row = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(names)), *(F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n))).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    parts = vectors[:, order].T
    parts = parts * np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(1)])[:, None]
    out = {f"pc{i + 1}": sum(((F.col(c) - float(row[f"m{j}"])) * float(parts[i, j]) for j, c in enumerate(names)), F.lit(0.0)) for i in range(len(parts))}
    return parts, values[order], df.withColumns(out)


def agglomerate(matrix: np.ndarray, linkage: str = "average") -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of a distance matrix: single, complete, average or ward; ids from n on are merged clusters."""
    d = matrix.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    n = len(d)
    ids, size, out = list(range(n)), [1] * n, []
    live = list(range(n))
    for step in range(n - 1):
        sub = d[np.ix_(live, live)]
        i, j = np.unravel_index(np.argmin(sub), sub.shape)
        a, b = live[min(i, j)], live[max(i, j)]
        h = d[a, b]
        out.append((ids[a], ids[b], float(h)))
        for k in live:
            if k in (a, b):
                continue
            x, y, na, nb, nk = d[a, k], d[b, k], size[a], size[b], size[k]
            d[a, k] = d[k, a] = {"single": min(x, y), "complete": max(x, y), "average": (na * x + nb * y) / (na + nb), "ward": (x * (na + nk) + y * (nb + nk) - h * nk) / (na + nb + nk)}[linkage]
        size[a] += size[b]
        ids[a] = n + step
        live.remove(b)
    return out


def mlknn_counts(neighbours: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(count of positive neighbours, own label, rows): what multi-label kNN's likelihoods are made of (see multilabel.ml_knn)."""
    pos = neighbours.join(labels.select(F.col(key).alias("neighbour"), F.col(label).alias("_l")), "neighbour").groupBy("probe").agg(F.sum("_l").alias("positives"))
    return pos.join(labels.select(F.col(key).alias("probe"), F.col(label).alias("own")), "probe").groupBy("positives", "own").agg(F.count("*").alias("n"))


def label_powerset(df: DataFrame, labels: Sequence[str], out: str = "powerset") -> DataFrame:
    return df.withColumn(out, F.concat_ws("", *(F.col(c).cast("string") for c in labels)))


def consensus(runs: DataFrame) -> DataFrame:
    """(a, b, share): of the runs that sampled both, in how many they were in one cluster. runs: (run, id, cluster).

    Ids of the same runs and clusters are one kind: shares are found for pairs of kinds, and each pair of ids looks its share up. Of more than MOST_KINDS kinds each pair of ids is counted.
    """
    own = runs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("run", "cluster"))).alias("runs"))
    kinds = own.select("runs").distinct()
    if (n := kinds.limit(MOST_KINDS + 1).count()) > MOST_KINDS:
        return _shares(runs, "id")
    kinds = pinned(kinds.withColumn("kind", F.row_number().over(Window.orderBy("runs")) - 1))
    each = kinds.select("kind", F.inline("runs"))
    shares = _shares(each, "kind", ordered=False).groupBy(F.col("a").alias("kind")).agg(F.map_from_entries(F.collect_list(F.struct("b", F.struct("share")))).alias("of"))
    row = F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda j: F.try_element_at("of", j))
    ids = pinned(own.join(F.broadcast(kinds), "runs").join(F.broadcast(shares.select("kind", row.alias("row"))), "kind").select("id", "kind", "row"))
    a, b = dealt(ids, "id").alias("a"), checked_broadcast(ids.select("id", "kind"), MOST_SENT).alias("b")
    found = F.get("a.row", F.col("b.kind"))
    return a.join(b, (F.col("a.id") < F.col("b.id")) & found.isNotNull()).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), found["share"].alias("share"))


def _shares(runs: DataFrame, of: str, ordered: bool = True) -> DataFrame:
    x, y = runs.alias("x"), runs.alias("y")
    same = F.col("x.run") == F.col("y.run")
    pairs = x.join(y, same & (F.col(f"x.{of}") < F.col(f"y.{of}")) if ordered else same)
    return pairs.groupBy(F.col(f"x.{of}").alias("a"), F.col(f"y.{of}").alias("b")).agg(F.avg((F.col("x.cluster") == F.col("y.cluster")).cast("double")).alias("share"))


def correspondence(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column coordinates and inertia of a contingency table."""
    p = table / table.sum()
    r, c = p.sum(1), p.sum(0)
    u, s, v = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)), full_matrices=False)
    return u * s / np.sqrt(r)[:, None], v.T * s / np.sqrt(c)[:, None], s * s


def torgerson(d: np.ndarray, k: int = 2) -> np.ndarray:
    """Classical scaling of a distance matrix."""
    n = len(d)
    j = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * j @ (d * d) @ j)
    order = np.argsort(-values)[:k]
    return vectors[:, order] * np.sqrt(np.maximum(values[order], 0))


def som_step(df: DataFrame, vector: str, nodes: np.ndarray, places: np.ndarray, radius: float) -> np.ndarray:
    """One batch step of a self-organizing map: assignment and sums by aggregation, neighbourhoods on the map's few nodes."""
    cells = [F.struct(F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, map(float, w))), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"), F.lit(i).alias("i")) for i, w in enumerate(nodes)]
    best = df.select(F.array_min(F.array(*cells))["i"].alias("i"), vector)
    sums = best.groupBy("i").agg(F.count("*").alias("n"), *(F.sum(F.get(vector, j)).alias(f"s{j}") for j in range(nodes.shape[1]))).collect()
    total, count = np.zeros_like(nodes, dtype=float), np.zeros(len(nodes))
    for r in sums:
        h = np.exp(-((places - places[r["i"]]) ** 2).sum(1) / (2 * radius * radius))
        total += h[:, None] * np.array([r[f"s{j}"] for j in range(nodes.shape[1])])
        count += h * r["n"]
    return np.where(count[:, None] > 1e-9, total / np.maximum(count, 1e-9)[:, None], nodes)
