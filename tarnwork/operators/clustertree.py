"""Predictive clustering trees: splits by how far apart, or how alike, rows are in several targets at once.

A level of the tree is one round for all its open nodes: sums and squares of the targets by node, column and value, running totals over a continuous column's
distinct values (so that every cut is tried, and no column is in one task), and a row per node with its best split, which is all that the driver gets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.relational import running
from tarnwork.schema import values_of


@dataclass
class ClusteringTree:
    """Splits a continuous column in two (at most a value, or more), a discrete one by its values.

    `measure` over the targets of the branches, of which targets are numbers and labels are places in the sorted list of values: `inter`, the mean squared distance
    between each two branches' means, the larger the better; `intra`, the sum over branches of the mean squared distance from their means, the
    smaller the better; `gini`, for labels only, the mean over labels of the branches' Gini index, by their shares of rows, which must fall below the node's.
    Each branch has `min_rows` rows. Of equal splits (to nine digits) the first column by name counts, and the lowest cut. A row whose value is unknown or new stays at the
    node, and gets its means; it plays no part in the node's choice by that column. Unknown targets are left out of their own sums. Of an empty table the tree predicts nothing.
    """

    continuous: Sequence[str] = ()
    discrete: Sequence[str] = ()
    targets: Sequence[str] = ()
    labels: Sequence[str] = ()
    measure: str = "inter"
    depth: int = 5
    min_rows: int = 5
    values: dict[str, list[str]] = field(default_factory=dict)
    #: By level: (node, column, cut or None, children by value or [at most, more]).
    levels: list[list[tuple]] = field(default_factory=list)
    prototypes: dict[int, dict] = field(default_factory=dict)

    def _numbers(self) -> list[Column]:
        places = [F.array_position(F.array(*map(F.lit, self.values[c])), F.col(c).cast("string")) - 1 for c in self.labels]
        return [*(F.col(c).cast("double") for c in self.targets), *(F.when(p >= 0, p).cast("double") for p in places)]

    def _parts(self) -> dict[str, Column]:
        """What is summed: of each target how many are known, their sum and squares; for `gini` the rows of each value."""
        out: dict[str, Column] = {"n": F.lit(1.0)}
        for k, x in enumerate(self._numbers()):
            out |= {f"n{k}": x.isNotNull().cast("double"), f"s{k}": F.coalesce(x, F.lit(0.0)), f"q{k}": F.coalesce(x * x, F.lit(0.0))}
        if self.measure == "gini":
            for k, c in enumerate(self.labels):
                out |= {f"n{k}_{j}": F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0)) for j, v in enumerate(self.values[c])}
        return out

    def _own(self, side: str) -> Column:
        """A branch's part in `intra` or `gini`, from its sums."""
        c = lambda name: F.col(f"{side}{name}")
        if self.measure == "gini":
            impure = [1 - sum(((c(f"n{k}_{j}") / c(f"n{k}")) ** 2 for j in range(len(self.values[x]))), F.lit(0.0)) for k, x in enumerate(self.labels)]
            return c("n") * sum((F.when(c(f"n{k}") > 0, g).otherwise(0.0) for k, g in enumerate(impure)), F.lit(0.0)) / len(self.labels)
        every = range(len(self.targets) + len(self.labels))
        return sum((F.when(c(f"n{k}") > 0, c(f"q{k}") - c(f"s{k}") * c(f"s{k}") / c(f"n{k}")).otherwise(0.0) for k in every), F.lit(0.0)) / c("n")

    def _mean(self, side: str, k: int) -> Column:
        return F.when(F.col(f"{side}n{k}") > 0, F.col(f"{side}s{k}") / F.col(f"{side}n{k}")).otherwise(0.0)

    def _cuts(self, at: DataFrame, parts: dict[str, Column]) -> DataFrame:
        """(_node, _column, cut, score) of every cut of every continuous column."""
        of = F.explode(F.array(*(F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("cut")) for c in self.continuous)))
        sums = at.select("_node", *(x.alias(n) for n, x in parts.items()), of.alias("_of")).select("*", "_of.*").where("cut is not null").groupBy("_node", "_column", "cut").agg(*(F.sum(n).alias(n) for n in parts))
        left = running(sums, ["cut"], {f"l_{n}": n for n in parts}, ["_node", "_column"])
        totals = sums.groupBy("_node", "_column").agg(*(F.sum(n).alias(f"t_{n}") for n in parts))
        both = left.join(totals, ["_node", "_column"]).withColumns({f"r_{n}": F.col(f"t_{n}") - F.col(f"l_{n}") for n in parts})
        both = both.where((F.col("l_n") >= self.min_rows) & (F.col("r_n") >= self.min_rows))
        if self.measure == "inter":
            score = sum(((self._mean("l_", k) - self._mean("r_", k)) ** 2 for k in range(len(self.targets) + len(self.labels))), F.lit(0.0))
        else:
            score = -(self._own("l_") + self._own("r_")) / (F.col("t_n") if self.measure == "gini" else F.lit(1.0))
        return both.select("_node", "_column", "cut", score.alias("score"))

    def _by_values(self, at: DataFrame, parts: dict[str, Column]) -> DataFrame:
        """(_node, _column, null, score) of each discrete column."""
        of = F.explode(F.array(*(F.struct(F.lit(c).alias("_column"), F.col(c).cast("string").alias("_value")) for c in self.discrete)))
        sums = at.select("_node", *(x.alias(n) for n, x in parts.items()), of.alias("_of")).select("*", "_of.*").where("_value is not null").groupBy("_node", "_column", "_value").agg(*(F.sum(n).alias(n) for n in parts))
        every = range(len(self.targets) + len(self.labels))
        means = [m for k in every for m in (F.sum(self._mean("", k)).alias(f"m{k}"), F.sum(self._mean("", k) ** 2).alias(f"mm{k}"))]
        found = sums.groupBy("_node", "_column").agg(F.count("*").alias("_k"), F.min("n").alias("_least"), F.sum("n").alias("t_n"), F.sum(self._own("")).alias("_inside"), *means)
        found = found.where((F.col("_k") > 1) & (F.col("_least") >= self.min_rows))
        if self.measure == "inter":  # the sum over pairs of squared distances, without pairs
            score = sum((F.col("_k") * F.col(f"mm{k}") - F.col(f"m{k}") ** 2 for k in every), F.lit(0.0)) / (F.col("_k") * (F.col("_k") - 1) / 2)
        else:
            score = -F.col("_inside") / (F.col("t_n") if self.measure == "gini" else F.lit(1.0))
        return found.select("_node", "_column", F.lit(None).cast("double").alias("cut"), score.alias("score"))

    def fit(self, df: DataFrame) -> ClusteringTree:
        if self.measure == "gini" and (self.targets or not self.labels):
            raise ValueError("gini is for labels")
        self.values = values_of(df, *dict.fromkeys([*self.labels, *self.discrete])) if self.labels or self.discrete else {}
        self.levels, self.prototypes = [], {}
        parts, open_, last = self._parts(), [1], 1
        for level in range(self.depth + 1):
            at = self._descended(df).where(F.col("_node").isin(open_))
            for r in at.groupBy("_node").agg(*(F.sum(x).alias(n) for n, x in parts.items())).collect():
                self.prototypes[r["_node"]] = r.asDict()
            if level == self.depth:
                break
            tried = [f(at, parts) for f, c in ((self._cuts, self.continuous), (self._by_values, self.discrete)) if c]
            if not tried:
                break
            first = F.min_by(F.struct("_column", "cut", "score"), F.struct(-F.round("score", 9), F.col("_column"), F.col("cut")))
            here = []
            for r in sorted(reduce(DataFrame.unionByName, tried).groupBy("_node").agg(first.alias("b")).collect(), key=lambda r: r["_node"]):
                own, (column, cut, score) = self.prototypes[r["_node"]], r["b"]
                if (self.measure == "inter" and score <= 1e-9) or (self.measure == "gini" and score <= self._gini(own) + 1e-9):
                    continue
                n = 2 if cut is not None else len(self.values[column])
                here.append((r["_node"], column, cut, list(range(last + 1, last + 1 + n))))
                last += n
            if not here:
                break
            self.levels.append(here)
            open_ = [c for *_, children in here for c in children]
        return self

    def _gini(self, own: dict) -> float:
        return -sum(1 - sum((own[f"n{k}_{j}"] / own[f"n{k}"]) ** 2 for j in range(len(self.values[c]))) for k, c in enumerate(self.labels) if own[f"n{k}"]) / len(self.labels)

    def _descended(self, df: DataFrame) -> DataFrame:
        """With each row's node so far: a CASE over a level's splits after another."""
        df = df.withColumn("_node", F.lit(1))
        for level in self.levels:
            step = F.when(F.lit(False), F.col("_node"))
            for node, column, cut, children in level:
                at, x = F.col("_node") == node, F.col(column)
                if cut is not None:
                    step = step.when(at & (x.cast("double") <= cut), children[0]).when(at & (x.cast("double") > cut), children[1])
                else:
                    place = F.array_position(F.array(*map(F.lit, self.values[column])), x.cast("string"))
                    step = step.when(at & (place > 0), F.get(F.array(*map(F.lit, children)), (place - 1).cast("int")))
            df = df.withColumn("_node", step.otherwise(F.col("_node")))
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        """With `leaf`, and a `prediction_<target>` of each target (its mean) and label (the value next to its mean place, for `gini` the most frequent one)."""
        rows = []
        parent = {c: node for level in self.levels for node, *_, children in level for c in children}
        for node in [1, *parent]:
            own = node
            while own not in self.prototypes and own in parent:  # a branch for a value that no row of the node has
                own = parent[own]
            r = self.prototypes.get(own)
            means = [r[f"s{k}"] / r[f"n{k}"] if r and r[f"n{k}"] else None for k in range(len(self.targets) + len(self.labels))]
            for k, c in enumerate(self.labels, len(self.targets)):
                if means[k] is not None:
                    counts = [r[f"n{k}_{j}"] for j in range(len(self.values[c]))] if self.measure == "gini" else []
                    means[k] = self.values[c][counts.index(max(counts)) if counts else int(means[k] + 0.5)]
            rows.append((node, *means))
        kinds = [f"`prediction_{c}` double" for c in self.targets] + [f"`prediction_{c}` string" for c in self.labels]
        table = df.sparkSession.createDataFrame(rows, ", ".join(["leaf int", *kinds]))  # a row for each node
        return self._descended(df).withColumnRenamed("_node", "leaf").join(F.broadcast(table), "leaf").select(*df.columns, *table.columns)

    def dump(self, node: int = 1, indent: int = 0) -> str:
        for level in self.levels:
            for at, column, cut, children in level:
                if at == node:
                    names = [f"<= {cut:g}", f"> {cut:g}"] if cut is not None else [f"= {v}" for v in self.values[column]]
                    return "".join(f"{' ' * indent}{column} {n}\n{self.dump(c, indent + 2)}" for n, c in zip(names, children, strict=True))
        r = self.prototypes.get(node)
        return f"{' ' * indent}-> {[round(r[f's{k}'] / r[f'n{k}'], 6) if r[f'n{k}'] else None for k in range(len(self.targets) + len(self.labels))] if r else '?'}\n"
