"""Function decomposition: an incompatibility matrix of bound by free values, its columns merged at the least expected error; a new feature in place of the bound ones, and removal of redundant columns.

The matrix is one aggregation: a row per combination of free values and of bound ones, with its rows of each class. Profits of merging two columns come from
a join on the free values, in which a key has a row per column at most. The driver holds a number per pair of columns, of which there are at most `MOST_COLUMNS`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.session import pinned

#: Different combinations of bound values; more are an error.
MOST_COLUMNS = 2000


def _value(name: str) -> Column:
    """Unknown is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("?"))


@dataclass
class Matrix:
    """cells: (row, col, n0, n1, ...) with the rows of each class; columns: the bound values of each col, in their order; priors of the classes."""

    bound: Sequence[str]
    cells: DataFrame
    columns: list[tuple[str, ...]]
    classes: list[str]
    priors: list[float]
    m: float

    def error(self, counts: Sequence[Column]) -> Column:
        """Rows expected to be misjudged in a cell, by the m-estimate of its best class."""
        n = sum(counts[1:], counts[0])
        likely = [c + self.m * p for c, p in zip(counts, self.priors, strict=True)]
        best = F.greatest(*likely) if len(likely) > 1 else likely[0]
        return n * (1 - best / (n + self.m))

    def _own(self, prefix: str = "") -> list[Column]:
        return [F.col(f"{prefix}n{k}") for k in range(len(self.classes))]

    def merged(self, into: dict[int, int]) -> DataFrame:
        moved = {a: b for a, b in into.items() if a != b}
        if not moved:
            return self.cells
        to = F.create_map(*(F.lit(x) for pair in moved.items() for x in pair))
        return self.cells.withColumn("col", F.coalesce(F.try_element_at(to, F.col("col")), "col")).groupBy("row", "col").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(len(self.classes))))

    def profits(self, cells: DataFrame, of: int | None = None) -> dict[tuple[int, int], float]:
        """Error that merging two columns saves (below 0: costs), over the rows that both have; of all pairs, or those of one column."""
        a = cells.select("row", F.col("col").alias("a"), *(F.col(f"n{k}").alias(f"a_n{k}") for k in range(len(self.classes))))
        b = cells.select("row", F.col("col").alias("b"), *(F.col(f"n{k}").alias(f"b_n{k}") for k in range(len(self.classes))))
        pairs = a.join(b, "row").where(F.col("a") < F.col("b")) if of is None else a.where(F.col("a") == of).join(b, "row").where(F.col("b") != of)
        x, y = self._own("a_"), self._own("b_")
        saved = self.error(x) + self.error(y) - self.error([p + q for p, q in zip(x, y, strict=True)])
        return {(min(r["a"], r["b"]), max(r["a"], r["b"])): r["p"] for r in pairs.groupBy("a", "b").agg(F.sum(saved).alias("p")).collect()}

    def quality(self) -> float:
        """Minus the expected error of a row, by the cells as they are; 0 without rows."""
        if not self.classes:
            return 0.0
        row = self.cells.agg(F.sum(self.error(self._own())).alias("e"), F.sum(sum(self._own()[1:], self._own()[0])).alias("n")).first()
        return -row["e"] / row["n"]


def matrix(df: DataFrame, bound: Sequence[str], free: Sequence[str], class_name: str, m: float = 2.0) -> Matrix:
    known = df.where(F.col(class_name).isNotNull()).select(F.struct(*map(_value, free)).alias("row") if free else F.lit(0).alias("row"), F.array(*map(_value, bound)).alias("_b"), F.col(class_name).cast("string").alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    classes = sorted(counts)
    total = sum(counts.values())
    found = [tuple(r[0]) for r in known.select("_b").distinct().limit(MOST_COLUMNS + 1).collect()]
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} combinations of {', '.join(bound)}")
    columns = sorted(found)
    numbers = df.sparkSession.createDataFrame([(list(c), k) for k, c in enumerate(columns)], "_b array<string>, col int")
    cells = known.join(F.broadcast(numbers), "_b").groupBy("row", "col").agg(F.count("*").alias("n"), *(F.count_if(F.col("_y") == y).cast("double").alias(f"n{k}") for k, y in enumerate(classes)))
    return Matrix(list(bound), pinned(cells), columns, classes, [counts[y] / total for y in classes], m)


@dataclass
class Feature:
    """A column made of the bound ones: the number of the merged column that their values are in; unknown for values not met."""

    bound: Sequence[str]
    groups: list[list[tuple[str, ...]]] = field(default_factory=list)

    def transform(self, df: DataFrame, name: str) -> DataFrame:
        rows = [(list(c), str(k)) for k, g in enumerate(self.groups) for c in g]
        known = df.sparkSession.createDataFrame(rows, f"_b array<string>, `{name}` string")
        return df.withColumn("_b", F.array(*map(_value, self.bound))).join(F.broadcast(known), "_b", "left").drop("_b")


def construct(df: DataFrame, bound: Sequence[str], free: Sequence[str], class_name: str, m: float = 2.0, least_profit: float = 0.0, most_values: int | None = None) -> Feature:
    """Columns are merged two at a time, the pair of the highest profit first (of equals, to nine digits, the first columns), while it is above `least_profit`, or until at most
    `most_values` are left. Pairs without a common row have profit 0. Rows of unknown class are left out.
    """
    x = matrix(df, bound, free, class_name, m)
    into = {k: k for k in range(len(x.columns))}
    live = set(into)
    profit = x.profits(x.cells) if len(live) > 1 else {}
    while len(live) > 1:
        if most_values is not None:
            if len(live) <= most_values:
                break
            options = {(a, b): profit.get((a, b), 0.0) for a in live for b in live if a < b}
        else:
            options = {p: v for p, v in profit.items() if v > least_profit + 1e-9}
        if not options:
            break
        a, b = min(options, key=lambda p: (-round(options[p], 9), p))
        into = {k: a if v == b else v for k, v in into.items()}
        live.discard(b)
        profit = {p: v for p, v in profit.items() if a not in p and b not in p} | (x.profits(x.merged(into), a) if len(live) > 1 else {})
    return Feature(list(bound), [[x.columns[k] for k, v in into.items() if v == g] for g in sorted(live)])


def im_scores(df: DataFrame, names: Sequence[str], class_name: str, m: float = 2.0) -> dict[str, float]:
    """Of each column against all others: minus the expected error in its incompatibility matrix."""
    return {c: matrix(df, [c], [n for n in names if n != c], class_name, m).quality() for c in names}


def redundant(df: DataFrame, names: Sequence[str], class_name: str, scores: dict[str, float] | None = None, m: float = 2.0, keep_values: bool = True) -> tuple[list[str], dict[str, Feature]]:
    """(columns that stay, columns put in place of others): a column whose values all merge, against the others that are left, goes, the least scored one (None: the one of fewest values)
    first; with keep_values off, one of which some merge is replaced by the merged one, <name>_r. Rounds go on until nothing changes.
    """
    left, made = list(names), {}
    tried: set[str] = set()
    scores = dict(scores or {r: float(n) for r, n in zip(names, df.agg(*(F.count_distinct(c) for c in names)).first(), strict=True)})
    again = True
    while again:
        again = False
        for c in sorted((c for c in left if c not in tried), key=lambda c: (scores.get(c, 0.0), c)):
            tried.add(c)
            feature = construct(df, [c], [n for n in left if n != c], class_name, m)
            values = sum(map(len, feature.groups))
            if len(feature.groups) <= 1:
                left.remove(c)
            elif not keep_values and len(feature.groups) < values:
                made[f"{c}_r"] = feature
                df = feature.transform(df, f"{c}_r")
                left[left.index(c)] = f"{c}_r"
                tried.add(f"{c}_r")
            else:
                continue
            again = True
            break
    return left, made
