"""Decision and regression trees with exact cuts, several ways to branch, unknown values and pruning.

A level is two passes over the rows for all its open nodes: sums by node, column and value with running totals over a continuous column's distinct values
(every cut is tried, and no column is in one task), and sums by branch of the chosen splits. The driver gets a row per node, then one per branch. Rows go down by
look-ups in an array of nodes, so an expression's size is that of the depth, not of the tree.
"""

from __future__ import annotations

import copy
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.operators.relational import running, spread
from tarnwork.schema import values_of
from tarnwork.session import pinned

#: An array of these is the tree: the column's place (-1: a leaf), the cut, children by value or [at most, more], where rows of unknown value go with which share, and the node's rows and impurity.
NODE = "array<struct<column: int, cut: double, kids: array<int>, spread: array<struct<node: int, share: double>>, n: double, impure: double>>"


def _xlogx(x: Column) -> Column:
    return F.when(x > 1e-12, x * F.log2(x)).otherwise(0.0)


@dataclass
class Node:
    sums: list[float]
    column: int = -1
    cut: float | None = None
    kids: list[int | None] = field(default_factory=list)
    own: int | None = None  # the branch of unknown values


@dataclass
class DecisionTree:
    """Of a discrete `target` (its classes as strings), or with `measure` = variance of a number.

    `measure`: info_gain, gain_ratio, gini or variance, each times the share of the node's rows whose value is known. A continuous column splits in two, halfway between
    two neighbouring values of the node; a discrete one by `branches`: `values` (one for each), `one` (a value against the others), `subset` (the best set against the others, found by ordering values
    by their mean, which is exact for numbers and two classes; more classes are an error). Each branch weighs `min_rows`; nodes of a purer majority than `max_majority` are not split.
    Of equal splits (to nine digits; of variance, as shares of the node's) the first column by name counts, then the lowest cut or value.

    Rows whose value is unknown (null, NaN, new to the node) go in training by `unknown`, in prediction by `unknown_at`: `shares` (to all branches by their weight), `common` (the heaviest), `all` (each branch with
    the whole weight; predictions are averaged), `branch` (one of their own; `shares` where training had none), `ignore` (they stay). Rows of unknown target or without a positive `weight` don't train.
    Of an empty table the tree predicts null.
    """

    continuous: Sequence[str]
    discrete: Sequence[str]
    target: str
    measure: str = "gain_ratio"
    branches: str = "values"
    unknown: str = "shares"
    unknown_at: str = "shares"
    depth: int = 10
    min_rows: float = 2
    max_majority: float = 1.0
    weight: str | None = None
    classes: list[str] = field(default_factory=list)
    values: dict[str, list[str]] = field(default_factory=dict)
    nodes: list[Node] = field(default_factory=list)

    @property
    def numeric(self) -> bool:
        return self.measure == "variance"

    @property
    def columns(self) -> list[str]:
        return [*self.continuous, *self.discrete]

    # -- sums and what follows from them

    def _parts(self) -> dict[str, Column]:
        """What is summed of a row, from `_w` and `_y`."""
        w, y = F.col("_w"), F.col("_y")
        if self.numeric:
            return {"n": w, "s": w * y, "q": w * y * y}
        return {"n": w, **{f"n{j}": F.when(y == c, w).otherwise(0.0) for j, c in enumerate(self.classes)}}

    def _impure(self, side: str) -> Column:
        """Impurity of a branch times its weight."""
        c = lambda name: F.col(f"{side}{name}")
        if self.numeric:
            return F.greatest(c("q") - c("s") * c("s") / c("n"), F.lit(0.0))
        each = [c(f"n{j}") for j in range(len(self.classes))]
        if self.measure == "gini":
            return c("n") - sum((x * x for x in each), F.lit(0.0)) / c("n")
        return _xlogx(c("n")) - sum(map(_xlogx, each), F.lit(0.0))

    def _impurity(self, sums: list[float]) -> float:
        n, rest = sums[0], sums[1:]
        if n <= 0:
            return 0.0
        if self.numeric:
            return max(rest[1] - rest[0] ** 2 / n, 0.0)
        if self.measure == "gini":
            return n - sum(x * x for x in rest) / n
        return n * math.log2(n) - sum(x * math.log2(x) for x in rest if x > 1e-12)

    def _score(self, inside: Column, logs: Column) -> Column:
        """Of a split with totals `t_`, branches of impurity `inside` and of summed n log n `logs`."""
        node = F.get(self._table(self.unknown), F.col("_node"))
        gain = (self._impure("t_") - inside) / node["n"]
        if self.numeric:
            return gain * node["n"] / node["impure"]
        return gain / ((_xlogx(F.col("t_n")) - logs) / F.col("t_n")) if self.measure == "gain_ratio" else gain

    def _two(self, both: DataFrame, cut: Column, left: Column) -> DataFrame:
        """Splits in two from what is on the left (`l_`) and in all (`t_`)."""
        both = both.withColumns({f"r_{n}": F.col(f"t_{n}") - F.col(f"l_{n}") for n in self._parts()})
        both = both.where((F.col("l_n") >= self.min_rows - 1e-9) & (F.col("r_n") >= self.min_rows - 1e-9) & (F.col("r_n") > 1e-9))
        score = self._score(self._impure("l_") + self._impure("r_"), _xlogx(F.col("l_n")) + _xlogx(F.col("r_n")))
        return both.select("_node", "_column", cut.alias("cut"), left.alias("left"), score.alias("score"))

    def _by(self, at: DataFrame, names: Sequence[str], kind: str) -> DataFrame:
        """Sums by node, column and known value."""
        of = F.explode(F.array(*(F.struct(F.lit(c).alias("_column"), F.get("_x", F.lit(self.columns.index(c))).alias("_value")) for c in names)))
        parts = self._parts()
        flat = at.select("_node", *(x.alias(n) for n, x in parts.items()), of.alias("_of")).select("*", "_of.*").where("_value is not null")
        return flat.groupBy("_node", "_column", F.col("_value").cast(kind).alias("_value")).agg(*(F.sum(n).alias(n) for n in parts))

    def _cuts(self, at: DataFrame) -> DataFrame:
        parts = self._parts()
        sums = self._by(at, self.continuous, "double")
        left = running(sums, ["_value"], {f"l_{n}": n for n in parts}, ["_node", "_column"])
        totals = sums.groupBy("_node", "_column").agg(*(F.sum(n).alias(f"t_{n}") for n in parts))
        return self._two(left.join(totals, ["_node", "_column"]), F.col("_value"), F.lit(None).cast("array<int>"))

    def _sets(self, at: DataFrame) -> DataFrame:
        """Of discrete columns; a node has as many sums as the column has values, so windows over them are small."""
        parts = self._parts()
        sums = self._by(at, self.discrete, "int")
        if self.branches == "values":
            found = sums.groupBy("_node", "_column").agg(*(F.sum(n).alias(f"t_{n}") for n in parts), F.count("*").alias("_k"), F.min("n").alias("_least"), F.sum(self._impure("")).alias("_in"), F.sum(_xlogx(F.col("n"))).alias("_logs"))
            found = found.where((F.col("_k") > 1) & (F.col("_least") >= self.min_rows - 1e-9))
            return found.select("_node", "_column", F.lit(None).cast("double").alias("cut"), F.lit(None).cast("array<int>").alias("left"), self._score(F.col("_in"), F.col("_logs")).alias("score"))
        whole = Window.partitionBy("_node", "_column")
        sums = sums.withColumns({f"t_{n}": F.sum(n).over(whole) for n in parts})
        if self.branches == "one":
            both, left = sums.withColumnsRenamed({n: f"l_{n}" for n in parts}), F.array("_value")
        else:
            mean = F.col("s") / F.col("n") if self.numeric else F.col("n1") / F.col("n") if len(self.classes) > 1 else F.lit(0.0)
            upto = whole.orderBy(mean, "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            both = sums.withColumns({**{f"l_{n}": F.sum(n).over(upto) for n in parts}, "_left": F.collect_list("_value").over(upto)})
            left = F.sort_array("_left")
        return self._two(both, F.lit(None).cast("double"), left)

    # -- down the tree

    def _spread(self, i: int, mode: str) -> list[tuple[int, float]]:
        node = self.nodes[i]
        kids = sorted({k for k in node.kids if k is not None})
        if node.column < 0 or mode == "ignore":
            return [(i, 1.0)]
        if mode == "branch" and node.own is not None:
            return [(node.own, 1.0)]
        sizes = [self.nodes[k].sums[0] for k in kids]
        if mode == "common":
            return [(kids[sizes.index(max(sizes))], 1.0)]
        if mode == "all":
            return [(k, 1.0) for k in kids]
        return [(k, s / sum(sizes)) for k, s in zip(kids, sizes, strict=True)]

    def _table(self, mode: str) -> Column:
        rows = [{"column": x.column, "cut": x.cut, "kids": x.kids, "spread": [{"node": k, "share": s} for k, s in self._spread(i, mode)], "n": x.sums[0], "impure": self._impurity(x.sums)} for i, x in enumerate(self.nodes)]
        return F.from_json(F.lit(json.dumps(rows)), NODE)

    @staticmethod
    def _child(node: Column) -> Column:
        """The branch of a row with values `_x` at a node, null where the value is unknown."""
        v = F.get("_x", node["column"])
        return F.get(node["kids"], F.when(node["cut"].isNotNull(), (v > node["cut"]).cast("int")).otherwise(v.cast("int")))

    def _prepared(self, df: DataFrame) -> DataFrame:
        """With `_x`: continuous values, and places of discrete ones."""
        x = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in self.continuous]
        for c in self.discrete:
            place = F.array_position(F.from_json(F.lit(json.dumps(self.values[c])), "array<string>"), F.col(c).cast("string"))
            x.append(F.when(place > 0, place - 1).cast("double"))
        return df.withColumn("_x", F.array(*x) if x else F.array().cast("array<double>"))

    def _descended(self, df: DataFrame, mode: str, levels: int) -> DataFrame:
        """With `_at`: (node, w) of a row, several where values are unknown."""
        table = self._table(mode)

        def step(e: Column) -> Column:
            node = F.get(table, e["node"])
            child = self._child(node)
            return F.when(child.isNotNull(), F.array(F.struct(child.alias("node"), e["w"].alias("w")))).otherwise(F.transform(node["spread"], lambda s: F.struct(s["node"].alias("node"), (s["share"] * e["w"]).alias("w"))))

        df = df.withColumn("_at", F.array(F.struct(F.lit(0).alias("node"), F.col("_w").alias("w"))))
        for _ in range(levels):
            df = df.withColumn("_at", F.flatten(F.transform("_at", step)))
        return df

    def fit(self, df: DataFrame) -> DecisionTree:
        y = F.col(self.target).cast("double" if self.numeric else "string")
        df = df.withColumns({"_y": F.when(~F.isnan(y), y) if self.numeric else y, "_w": F.coalesce(F.col(self.weight).cast("double"), F.lit(0.0)) if self.weight else F.lit(1.0)})
        df = df.where(F.col("_y").isNotNull() & (F.col("_w") > 0))
        found = values_of(df, *dict.fromkeys([*self.discrete, *([] if self.numeric else ["_y"])])) if self.discrete or not self.numeric else {}
        self.classes = found.pop("_y", [])
        self.values = found
        if self.branches == "subset" and len(self.classes) > 2:
            raise ValueError("subsets of values are for two classes or numbers")
        rows, parts = pinned(spread(self._prepared(df).select("_x", "_y", "_w"))), self._parts()
        whole = rows.agg(*(F.sum(x).alias(n) for n, x in parts.items())).first()
        self.nodes = [Node([whole[n] or 0.0 for n in parts])]
        open_ = [0]
        for level in range(self.depth):
            open_ = [i for i in open_ if self._worth(self.nodes[i].sums)]
            tried = [f for f, c in ((self._cuts, self.continuous), (self._sets, self.discrete)) if c]
            if not open_ or not tried:
                break
            at = self._descended(rows, self.unknown, level).select("_x", "_y", F.explode("_at").alias("_e")).select("_x", "_y", F.col("_e.node").alias("_node"), F.col("_e.w").alias("_w")).where(F.col("_node").isin(open_))
            first = F.min_by(F.struct("_column", "cut", "left", "score"), F.struct(-F.round("score", 9), F.col("_column"), F.col("cut"), F.col("left")))
            best = {r["_node"]: r["b"] for r in reduce(DataFrame.unionByName, (f(at) for f in tried)).groupBy("_node").agg(first.alias("b")).collect() if r["b"]["score"] > 1e-9}
            if not best:
                break
            open_ = self._branched(at, best, parts)
        return self

    def _worth(self, sums: list[float]) -> bool:
        top = 0.0 if self.numeric else max(sums[1:], default=0.0)
        impure = self._impurity(sums)
        return sums[0] > 0 and sums[0] >= 2 * self.min_rows - 1e-9 and (impure > 1e-12 * (abs(sums[2]) + 1) if self.numeric else top < self.max_majority * sums[0] - 1e-9 and impure > 1e-9)

    def _branched(self, at: DataFrame, best: dict, parts: dict[str, Column]) -> list[int]:
        """Nodes for the branches of the chosen splits; their sums, and the value above a cut, come from one aggregation."""
        for i, b in best.items():  # branches by number until their nodes are made
            node = self.nodes[i]
            node.column, node.cut = self.columns.index(b["_column"]), b["cut"]
            k = len(self.values.get(b["_column"], ()))
            node.kids = [0, 1] if b["cut"] is not None else list(range(k)) if b["left"] is None else [int(v not in b["left"]) for v in range(k)]
        table = F.from_json(F.lit(json.dumps([{"column": x.column, "cut": x.cut, "kids": x.kids} for x in self.nodes])), NODE)
        here = F.get(table, F.col("_node"))
        sums = [F.sum(x).alias(n) for n, x in parts.items()]
        rows = at.where(F.col("_node").isin(list(best))).groupBy("_node", self._child(here).alias("_b")).agg(*sums, F.min(F.get("_x", here["column"])).alias("_low"), F.max(F.get("_x", here["column"])).alias("_high")).collect()
        grown: list[int] = []
        for i in sorted(best):
            node = self.nodes[i]
            known = {r["_b"]: r for r in rows if r["_node"] == i and r["_b"] is not None}
            lost = next(([r[n] for n in parts] for r in rows if r["_node"] == i and r["_b"] is None), [0.0] * len(parts))
            if node.cut is not None:
                low, high = known[1]["_low"], known[0]["_high"]
                middle = high + (low - high) / 2
                node.cut = middle if high <= middle < low else high
            place = {b: len(self.nodes) + k for k, b in enumerate(sorted(known))}
            self.nodes += [Node([known[b][n] for n in parts]) for b in sorted(known)]
            node.kids = [place.get(b) for b in node.kids]
            if self.unknown == "branch" and lost[0] > 0:
                node.own = len(self.nodes)
                self.nodes.append(Node(list(lost)))
            else:
                for k, share in [] if self.unknown == "ignore" else self._spread(i, self.unknown):
                    self.nodes[k].sums = [a + share * b for a, b in zip(self.nodes[k].sums, lost, strict=True)]
            grown += [*place.values(), *([node.own] if node.own is not None else [])]
        return grown

    # -- use

    def _answers(self) -> list[list[float] | None]:
        """Each node's mean, or shares of the classes."""
        return [None if x.sums[0] <= 0 else [x.sums[1] / x.sums[0]] if self.numeric else [v / x.sums[0] for v in x.sums[1:]] for x in self.nodes]

    def transform(self, df: DataFrame) -> DataFrame:
        """With `prediction`; of classes also `probability`, in the order of `classes`, whose highest (the first of equals) is predicted."""
        kept = df.columns
        if self.nodes[0].sums[0] <= 0:
            return df.withColumn("prediction", F.lit(None).cast("double" if self.numeric else "string"))
        down = self._descended(self._prepared(spread(df).withColumn("_w", F.lit(1.0))), self.unknown_at, self._depth())
        answers = F.from_json(F.lit(json.dumps(self._answers())), "array<array<double>>")
        total = F.aggregate("_at", F.lit(0.0), lambda a, e: a + e["w"])
        mean = lambda j: F.aggregate("_at", F.lit(0.0), lambda a, e: a + e["w"] * F.get(F.get(answers, e["node"]), F.lit(j))) / total
        mixed = [mean(j) for j in range(1 if self.numeric else len(self.classes))]
        if self.numeric:
            return down.withColumn("prediction", mixed[0]).select(*kept, "prediction")
        down = down.withColumn("probability", F.array(*mixed))
        best = F.array_position("probability", F.array_max("probability"))
        return down.withColumn("prediction", F.get(F.from_json(F.lit(json.dumps(self.classes)), "array<string>"), (best - 1).cast("int"))).select(*kept, "prediction", "probability")

    def _under(self, i: int) -> list[int]:
        node = self.nodes[i]
        return [] if node.column < 0 else sorted({k for k in [*node.kids, node.own] if k is not None})

    def _depth(self, i: int = 0) -> int:
        return max((1 + self._depth(k) for k in self._under(i)), default=0)

    def size(self, i: int = 0) -> int:
        """Nodes below, and the node."""
        return 1 + sum(map(self.size, self._under(i)))

    def _cut_back(self, i: int) -> None:
        self.nodes[i].column, self.nodes[i].cut, self.nodes[i].kids, self.nodes[i].own = -1, None, [], None

    def pruned(self, m: float = 2.0) -> DecisionTree:
        """A copy without branches that don't lower the expected error: of classes 1 - the highest m-estimate, of numbers the m-estimate of the variance, with the root's as prior; branches count by weight."""
        out = copy.deepcopy(self)
        root = self.nodes[0].sums

        def error(sums: list[float]) -> float:
            if sums[0] + m <= 0 or root[0] <= 0:
                return 0.0
            if self.numeric:
                return (self._impurity(sums) + m * self._impurity(root) / root[0]) / (sums[0] + m)
            return 1 - max(v + m * p / root[0] for v, p in zip(sums[1:], root[1:], strict=True)) / (sums[0] + m)

        def back(i: int) -> float:
            own, under = error(out.nodes[i].sums), out._under(i)
            if not under:
                return own
            sizes = [out.nodes[k].sums[0] for k in under]
            below = sum(s * back(k) for k, s in zip(under, sizes, strict=True)) / sum(sizes)
            if own <= below + 1e-12:
                out._cut_back(i)
                return own
            return below

        back(0)
        return out

    def merged(self) -> DecisionTree:
        """A copy in which a node whose leaves all share a majority class is a leaf."""
        if self.numeric:
            raise ValueError("majorities are of classes")
        out = copy.deepcopy(self)

        def tops(i: int) -> set[int]:
            counts, under = out.nodes[i].sums[1:], out._under(i)
            if not under:
                return {j for j, v in enumerate(counts) if v == max(counts)}
            shared = set.intersection(*map(tops, under))
            if shared:
                out._cut_back(i)
            return shared

        tops(0)
        return out

    def dump(self, i: int = 0, indent: int = 0) -> str:
        node, answer = self.nodes[i], self._answers()[i]
        if node.column < 0:
            said = "?" if answer is None else f"{answer[0]:g}" if self.numeric else self.classes[answer.index(max(answer))]
            return f"{' ' * indent}-> {said} ({node.sums[0]:g})\n"
        name, out = self.columns[node.column], ""
        for k in self._under(i):
            values = [v for v, kid in zip(self.values.get(name, ()), node.kids, strict=False) if kid == k]
            said = "unknown" if k == node.own else f"in {', '.join(values)}" if node.cut is None else f"{'<=' if k == node.kids[0] else '>'} {node.cut:g}"
            out += f"{' ' * indent}{name} {said}\n{self.dump(k, indent + 2)}"
        return out
