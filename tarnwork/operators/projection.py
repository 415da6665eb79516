"""Projections: correspondence analysis of two columns, self-organizing maps, scaling of a distance matrix by majorization."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.operators import learn
from tarnwork.operators.aggregate import contingency

#: Values of a column that a correspondence analysis takes; more are an error.
MOST_VALUES = 2000


def correspondence_table(df: DataFrame, a: str, b: str) -> tuple[dict, dict, np.ndarray]:
    """({value of a: coordinates}, {value of b: coordinates}, inertia): the contingency is one aggregation, its decomposition small."""
    cells = contingency(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b).limit(MOST_VALUES * MOST_VALUES).collect()
    rows, cols = sorted({r["outer"] for r in cells}), sorted({r["inner"] for r in cells})
    if max(len(rows), len(cols)) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} values")
    table = np.zeros((len(rows), len(cols)))
    for r in cells:
        table[rows.index(r["outer"]), cols.index(r["inner"])] = r["weight"]
    x, y, inertia = learn.correspondence(table)
    return dict(zip(rows, x, strict=True)), dict(zip(cols, y, strict=True)), inertia


@dataclass
class Map:
    """A trained map: the nodes' vectors and their places."""

    vector: str
    nodes: np.ndarray
    places: np.ndarray

    def assign(self, df: DataFrame) -> DataFrame:
        """`df` with the nearest node of each row, and its squared distance."""
        cells = [F.struct(F.aggregate(F.zip_with(F.col(self.vector), F.array(*map(F.lit, map(float, w))), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"), F.lit(i).alias("i")) for i, w in enumerate(self.nodes)]
        return df.withColumn("_best", F.array_min(F.array(*cells))).withColumns({"node": F.col("_best.i"), "error": F.col("_best.d")}).drop("_best")

    def u_matrix(self) -> dict[tuple[int, int], float]:
        """Distances between the vectors of nodes that are neighbours on the map."""
        near = [(i, j) for i in range(len(self.places)) for j in range(i) if np.linalg.norm(self.places[i] - self.places[j]) <= 1.001]
        return {(i, j): float(np.linalg.norm(self.nodes[i] - self.nodes[j])) for i, j in near}


def som(df: DataFrame, vector: str, places: np.ndarray, rounds: int = 20, seed: int = 0) -> Map:
    """A map over nodes at `places`, by batch steps of a shrinking neighbourhood: each is one aggregation over all rows."""
    size = df.select(F.max(F.size(vector))).first()[0] or 0
    row = df.agg(*(f(F.get(vector, j)).alias(f"{n}{j}") for j in range(size) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean, spread = (np.array([row[f"{n}{j}"] or 0.0 for j in range(size)]) for n in "ms")
    nodes = mean + spread * np.random.default_rng(seed).normal(size=(len(places), size))
    widest = max(np.ptp(places, axis=0).max(), 1.0)
    for t in range(rounds):
        nodes = learn.som_step(df, vector, nodes, places, widest * (0.3 / widest) ** (t / max(rounds - 1, 1)))
    return Map(vector, nodes, places)


def stress(d: np.ndarray, x: np.ndarray) -> float:
    """Sum of squared differences between distances and those of the points."""
    own = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    return float(((d - own) ** 2).sum() / 2)


def smacof(d: np.ndarray, x: np.ndarray, rounds: int = 300, least: float = 1e-7) -> np.ndarray:
    """Points moved from x by Guttman's transform, by which stress never rises, until it falls by less than a share of `least`. d is a small matrix."""
    n, before = len(d), stress(d, x)
    for _ in range(rounds):
        own = np.sqrt(((x[:, None] - x) ** 2).sum(2))
        ratio = np.where(own > 1e-12, d / np.where(own > 1e-12, own, 1), 0)
        b = -ratio
        b[np.arange(n), np.arange(n)] = ratio.sum(1) - ratio[np.arange(n), np.arange(n)]
        x = b @ x / n
        now = stress(d, x)
        if before - now <= least * before:
            break
        before = now
    return x


@dataclass
class Components:
    """Principal components of standardized columns, as many as are asked for or cover a share of the variance; with a class, of the differences between rows of different classes.

    The matrix comes from one aggregation of products; with a class, by class: the sum over pairs of rows of different classes of their differences' products is
    that of rows' own products, each times the rows of other classes, less the products of sums of different classes, so that no pair is made. Unknown values count
    as their column's mean; constant columns have no part. Rows of unknown class are left out of the fit. A table without rows, or of constant columns only, is an error.
    """

    names: list[str]
    standardize: bool = True
    most: int = 0  # 0: all
    covered: float = 1.0
    class_name: str | None = None
    ddof: int = 1
    means: np.ndarray | None = None
    scales: np.ndarray | None = None
    components: np.ndarray | None = None
    variances: np.ndarray | None = None
    variance_sum: float = 0.0

    def _z(self) -> list[Column]:
        return [F.coalesce((F.col(c).cast("double") - float(m)) / float(s), F.lit(0.0)) for c, m, s in zip(self.names, self.means, self.scales, strict=True)]

    def fit(self, df: DataFrame) -> Components:
        rows = df.where(F.col(self.class_name).isNotNull()) if self.class_name else df
        k = len(self.names)
        spread = F.var_samp if self.ddof else F.var_pop
        row = rows.agg(F.count("*").alias("n"), *(f(F.col(c).cast("double")).alias(f"{p}{i}") for i, c in enumerate(self.names) for p, f in (("m", F.avg), ("v", spread)))).first()
        spreads = np.array([row[f"v{i}"] or 0.0 for i in range(k)])
        if not (spreads > 0).any():
            raise ValueError("no rows, or all columns are constant")
        self.means = np.array([row[f"m{i}"] or 0.0 for i in range(k)])
        self.scales = np.where(spreads > 0, np.sqrt(spreads), 1.0) if self.standardize else np.ones(k)
        z = self._z()
        sums = [F.count("*").alias("n"), *(F.sum(z[i]).alias(f"s{i}") for i in range(k)), *(F.sum(z[i] * z[j]).alias(f"q{i}_{j}") for i in range(k) for j in range(i, k))]
        parts = (rows.groupBy(self.class_name) if self.class_name else rows.groupBy()).agg(*sums).collect()  # classes are few
        n, matrix, whole = row["n"], np.zeros((k, k)), np.zeros(k)
        for r in parts:
            q = np.array([[r[f"q{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
            s = np.array([r[f"s{i}"] for i in range(k)])
            matrix += (n - r["n"]) * q + np.outer(s, s) if self.class_name else q
            whole += s
        matrix = (matrix - np.outer(whole, whole) if self.class_name else matrix) / (n - self.ddof)
        values, vectors = np.linalg.eigh(matrix)
        order = np.argsort(-values)
        values, vectors = np.maximum(values[order], 0), vectors[:, order].T
        vectors *= np.sign(vectors[np.arange(k), np.abs(vectors).argmax(1)])[:, None]
        self.variance_sum = float(values.sum())
        keep = k if self.covered >= 1 else int(np.searchsorted(np.cumsum(values) / self.variance_sum, self.covered)) + 1
        keep = min(keep, self.most or k)
        self.variances, self.components = values[:keep], vectors[:keep]
        return self

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        z = self._z()
        return df.withColumns({f"{prefix}{i + 1}": sum((x * float(w) for x, w in zip(z, row, strict=True)), F.lit(0.0)) for i, row in enumerate(self.components)})
