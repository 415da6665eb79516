"""Rule induction over discrete columns: ordered lists, unordered rules, weighted covering, and qualities corrected for the best of many being best by chance.

Rows are first counted by their values and class. All candidates of a round of the beam search are counted in one pass: the beam's rules times the values of all
other columns, by an aggregation that gives a row per candidate. The simulations of permuted classes share their passes too: tasks
draw the target's rows of each cell for all of them, and add up what each one's beam asks for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.session import pinned

Conditions = tuple[tuple[str, str], ...]


def chi(p: np.ndarray | float, n: np.ndarray | float, pos: np.ndarray | float, neg: np.ndarray | float) -> np.ndarray:
    """Likelihood ratio statistic of p positives and n negatives out of pos and neg, half a row moved against the rule; 0 where it is not better than the whole."""
    p, n, pos, neg = np.broadcast_arrays(*(np.asarray(v, float) for v in (p, n, pos, neg)))
    p, n = p - 0.5, n + 0.5
    share = pos / np.maximum(pos + neg, 1e-300)
    log = lambda x: np.log(np.maximum(x, 1e-300))
    out_p, out_n, rest = pos - p, neg - n, pos + neg - p - n
    value = 2 * (p * log(p / np.maximum((p + n) * share, 1e-300)) + n * log(n / (p + n)) + out_p * log(out_p / np.maximum(rest, 1e-300)) + out_n * log(out_n / np.maximum(rest, 1e-300)) - out_p * log(share) - neg * log(1 - share))
    return np.where((p <= 0) | (p <= (p + n) * share) | (neg <= 0) | (rest <= 0), 0.0, value)


def chi_tail(x: float) -> float:
    """Half the chance that a chi-square of one degree of freedom is above x."""
    return 0.5 * math.erfc(math.sqrt(max(x, 0) / 2))


def _root(f: Callable[[float], float], low: float, high: float) -> float:
    """Where a falling function is 0, or the nearer end."""
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) > 0 else (low, middle)
    return (low + high) / 2


@dataclass(frozen=True)
class Extreme:
    """Fisher-Tippett distribution of the best statistic of a rule of so many conditions, where the class has nothing to do with the columns."""

    mu: float
    beta: float = 2.0

    @property
    def median(self) -> float:
        return self.mu - self.beta * math.log(math.log(2))

    def corrected(self, value: float) -> float:
        """The statistic that a rule chosen beforehand would need for the chance that the best of all has of reaching `value`."""
        chance = -math.expm1(-math.exp(min((self.mu - value) / self.beta, math.log(math.log(1 / 0.05)))))
        return 0.0 if chance >= 0.5 else min(value, _root(lambda x: chi_tail(x) - chance, 0.0, 1400.0))


@dataclass
class Rule:
    conditions: Conditions
    quality: float
    positives: float  # weighted where rows are
    covered: float
    share: float = 0.0  # positives among the covered as far as they are to be believed

    def applies(self) -> Column:
        return reduce(lambda a, b: a & b, (F.coalesce(F.col(c).cast("string") == v, F.lit(False)) for c, v in self.conditions), F.lit(True))


def laplace(p: float, n: float, pos: float, all_: float) -> float:
    return (p + 1) / (n + 2)


def m_estimate(m: float) -> Callable[..., float]:
    return lambda p, n, pos, all_: (p + m * pos / all_) / (n + m)


def relative_accuracy(p: float, n: float, pos: float, all_: float) -> float:
    return n / all_ * (p / n - pos / all_)


@dataclass
class RuleLearner:
    """Rules for each class over discrete columns; unknown values meet no condition, rows of unknown class are left out.

    `covering`: `ordered` (a list: for all classes at once, rows that a rule covers are gone), `unordered` (for each class, its rows that a rule covers are gone), `weighted` (their
    weight goes down by `factor` with every rule, for relative accuracy), `probable` (a rule must be better than what `least_improved` of its class's rows
    have so far). `measure`: laplace, m, wracc, or evc: an m-estimate of the positives that remain when the statistic is corrected by `simulations` of
    permuted classes. The search keeps the `beam` best rules of each length up to `length`, as long as their statistic is significant at `alpha` (1: any).
    """

    names: Sequence[str]
    class_name: str
    covering: str = "unordered"
    measure: str = "laplace"
    beam: int = 5
    length: int = 5
    m: float = 2.0
    alpha: float = 1.0
    factor: float = 0.7
    least_covered: int = 1
    least_improved: int = 1
    most_rules: int = 1000
    simulations: int = 100
    seed: int = 0
    rules: list[tuple[str, Rule]] = field(default_factory=list)
    shares: dict[str, float] = field(default_factory=dict)
    extremes: dict[str, list[Extreme]] = field(default_factory=dict)

    # -- counting -------------------------------------------------------------------

    def cells(self, df: DataFrame) -> DataFrame:
        """(names..., _y, _n): rows counted by values and class."""
        known = df.where(F.col(self.class_name).isNotNull())
        return pinned(known.groupBy(*(F.col(c).cast("string").alias(c) for c in self.names), F.col(self.class_name).cast("string").alias("_y")).agg(F.count("*").cast("double").alias("_n")))

    def counted(self, cells: DataFrame, front: list[Conditions], extra: dict[str, Column]) -> dict[Conditions, dict[str, float]]:
        """Sums of `extra` over what each rule of the front with one condition more covers; conditions are in the order of columns."""
        covered = F.filter(F.array(*(F.when(Rule(c, 0, 0, 0).applies(), F.lit(k)) for k, c in enumerate(front))), lambda k: k.isNotNull())
        value = F.explode(F.array(*(F.struct(F.lit(c).alias("_c"), F.col(c).alias("_v")) for c in self.names)))
        rows = cells.select(F.explode(covered).alias("_k"), value.alias("_s"), *(x.alias(n) for n, x in extra.items()))
        found = rows.where("_s._v is not null").groupBy("_k", "_s._c", "_s._v").agg(*(F.sum(n).alias(n) for n in extra)).collect()  # a row for each candidate
        out = {}
        for r in found:
            if r["_c"] not in {c for c, _ in front[r["_k"]]}:
                rule = tuple(sorted((*front[r["_k"]], (r["_c"], r["_v"]))))
                out[rule] = {n: r[n] for n in extra}
        return out

    # -- what is best by chance -----------------------------------------------------

    def best_by_chance(self, cells: DataFrame, target: str) -> np.ndarray:
        """[simulation, length - 1]: the best statistic of a rule of at most so many conditions, with classes dealt out anew among all rows."""
        pos, all_ = cells.agg(F.coalesce(F.sum(F.when(F.col("_y") == target, F.col("_n"))), F.lit(0.0)), F.sum("_n")).first()
        whole = pinned(cells.groupBy(*self.names).agg(F.sum("_n").alias("_n")))
        names, seed, sims, share = list(self.names), self.seed, self.simulations, pos / all_

        def drawn(rows: pd.DataFrame) -> np.ndarray:
            """[cell, simulation]: positives of each cell, the same however often they are drawn."""
            keys = pd.util.hash_pandas_object(rows[names].fillna("\x00"), index=False).to_numpy()
            return np.array([np.random.default_rng([seed, int(k)]).binomial(int(n), share, sims) for k, n in zip(keys, rows["_n"], strict=True)], float).reshape(len(rows), sims)

        def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p = sum((drawn(rows).sum(0) for rows in batches), np.zeros(sims))
            yield pd.DataFrame({"sim": np.arange(sims), "p": p})

        sums = {r["sim"]: r["p"] for r in whole.mapInPandas(totals, "sim int, p double").groupBy("sim").agg(F.sum("p").alias("p")).collect()}
        front: list[list[Conditions]] = [[()] for _ in range(sims)]
        best = np.zeros((sims, self.length))
        for length in range(self.length):
            asked = front

            def count(batches: Iterator[pd.DataFrame], asked: list[list[Conditions]] = asked) -> Iterator[pd.DataFrame]:
                sets = sorted({c for f in asked for c in f})
                who = {c: [s for s in range(sims) if c in asked[s]] for c in sets}
                found: dict = {}
                for rows in batches:
                    p, n = drawn(rows), rows["_n"].to_numpy(float)
                    for k, conditions in enumerate(sets):
                        on = np.ones(len(rows), bool)
                        for c, v in conditions:
                            on &= (rows[c] == v).to_numpy()
                        for c in names if on.any() else ():
                            if c not in {x for x, _ in conditions}:
                                codes, values = pd.factorize(rows[c].to_numpy()[on])  # unknown values are -1
                                for j, v in enumerate(values):
                                    at = np.flatnonzero(on)[codes == j]
                                    old = found.setdefault((k, c, v), [np.zeros(len(who[conditions])), 0.0])
                                    old[0] += p[at][:, who[conditions]].sum(0)
                                    old[1] += n[at].sum()
                out = [(s, k, c, v, ps[i], n) for (k, c, v), (ps, n) in found.items() for i, s in enumerate(who[sets[k]])]
                yield pd.DataFrame(out, columns=["sim", "k", "c", "v", "p", "n"])

            sets = sorted({c for f in asked for c in f})
            rows = whole.mapInPandas(count, "sim int, k int, c string, v string, p double, n double").groupBy("sim", "k", "c", "v").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).toPandas()
            if not len(rows):
                best[:, length:] = best[:, max(length - 1, 0)][:, None]
                break
            total = rows["sim"].map(sums).to_numpy()
            rows["x"] = np.where(rows["n"] < all_, chi(rows["p"], rows["n"] - rows["p"], total, all_ - total), 0.0)
            front = [[] for _ in range(sims)]
            for s, own in rows.groupby("sim"):
                rules = {tuple(sorted((*sets[k], (c, v)))): x for k, c, v, x in zip(own["k"], own["c"], own["v"], own["x"], strict=True)}
                front[s] = sorted(rules, key=lambda r: (-rules[r], r))[: self.beam]
                best[s, length] = max(rules.values())
        return np.maximum.accumulate(best, 1)

    def fit_extremes(self, best: np.ndarray) -> list[Extreme]:
        """By length: mu from the mean of the best, beta as for a chi-square; mu never falls with length, and is 1 at least."""
        mu, out = 1.0, []
        for column in best.T:
            mu = max(mu, float(column.mean()) - 2.0 * 0.5772156649)
            out.append(Extreme(mu))
        return out

    def corrected(self, p: float, n: float, pos: float, all_: float, by: Extreme, parent: float | None = None) -> float:
        """Positives among n covered rows, of which p are positive, without what the choice of the best adds. `parent`: what such a correction leaves of the rule with a condition less, as a share of its positives."""
        base, value = pos / all_, float(chi(p, n - p, pos, all_ - pos))
        if by.mu < 1.0001 or p / n < base:
            return p
        if value <= by.median + 1e-6 or (least := by.corrected(value)) <= 0:
            return n * base
        kept = _root(lambda x: least - float(chi(x, n - x, pos, all_ - pos)), n * base, p)
        if n == p:  # nothing speaks against the rule: how far it goes is known less well
            if parent is None:
                kept = (0.634 * kept / p + 0.366) * p
            elif kept / p < parent:
                kept = (kept / p + (parent - kept / p) * 0.366) * p
        return kept

    # -- the search -----------------------------------------------------------------

    def _quality(self, p: float, n: float, pos: float, all_: float, size: int, target: str, parent: float | None) -> tuple[float, float]:
        """(quality, share of positives to be believed)."""
        if self.measure != "evc":
            return {"laplace": laplace, "m": m_estimate(self.m), "wracc": relative_accuracy}[self.measure](p, n, pos, all_), p / n
        kept = self.corrected(p, n, pos, all_, self.extremes[target][size - 1], parent)
        return (kept + self.m * pos / all_) / (n + self.m), kept / n

    @staticmethod
    def _order(found: tuple[str, Rule]) -> tuple:
        t, r = found
        return -round(r.quality, 12), len(r.conditions), r.conditions, t

    def _tried(self, cells: DataFrame, targets: Sequence[str]) -> Iterator[list[tuple[str, Rule]]]:
        """For each length the rules of the beam search over cells of rows with a weight, best first."""
        weight = F.col("_n") * F.col("_w")
        extra = {"all": weight, "rows": F.col("_n")} | {f"p{k}": F.when(F.col("_y") == t, weight).otherwise(0.0) for k, t in enumerate(targets)}
        whole = cells.agg(*(F.sum(x).alias(n) for n, x in extra.items())).first()
        if not whole["all"]:
            return
        front: list[tuple[Rule, Conditions]] = [(Rule((), 0, 0, 0, 1.0), ())]
        for size in range(1, self.length + 1):
            tried = []
            parents = {c: r for r, c in front}
            for conditions, r in self.counted(cells, [c for _, c in front], extra).items():
                if r["rows"] < self.least_covered:
                    continue
                parent = next((parents[c] for c in parents if set(c) < set(conditions)), None)
                for k, t in enumerate(targets):
                    if r[f"p{k}"] > 0:
                        left = parent.share / (parent.positives / parent.covered) if parent and parent.positives else None
                        quality, share = self._quality(r[f"p{k}"], r["all"], whole[f"p{k}"], whole["all"], size, t, left)
                        if self.alpha >= 1 or 2 * chi_tail(float(chi(r[f"p{k}"], r["all"] - r[f"p{k}"], whole[f"p{k}"], whole["all"] - whole[f"p{k}"]))) <= self.alpha:
                            tried.append((t, Rule(conditions, quality, r[f"p{k}"], r["all"], share)))
            tried.sort(key=self._order)
            if not tried:
                break
            yield tried
            seen: dict[Conditions, Rule] = {}
            for _, r in tried:
                seen.setdefault(r.conditions, r)
            front = [(r, c) for c, r in list(seen.items())[: self.beam]]

    def best_rule(self, cells: DataFrame, targets: Sequence[str]) -> tuple[str, Rule] | None:
        """The best rule of any of the classes over cells of rows with a weight."""
        return min((tried[0] for tried in self._tried(cells, targets)), key=self._order, default=None)

    def _improving(self, cells: DataFrame, target: str) -> None:
        """Takes rules, best first, each of which is better than what enough rows of its class have from those before.

        The search counts all rows, whatever they have, so it is made once; and a rule that is no improvement never becomes one. Rules are looked at in parts: positive rows are counted by
        which rules of the part would improve them, so a pass brings at most 2^12 rows, and what the part's own rules give is taken off here.
        """
        own = cells.where(F.col("_y") == target)
        tried = sorted((x for part in self._tried(cells, [target]) for x in part if x[1].quality > self.shares[target] + 1e-3), key=self._order)
        for at in range(0, len(tried), 12):
            part = [r for _, r in tried[at : at + 12]]
            which = sum((F.when(r.applies() & (F.col("_best") < r.quality), F.lit(1 << k)).otherwise(0) for k, r in enumerate(part)), F.lit(0))
            rows = [(int(x["which"]), x["n"]) for x in own.groupBy(which.alias("which")).agg(F.sum("_n").alias("n")).collect()]
            taken = []
            for k, r in enumerate(part):
                done = sum(1 << j for j in taken if part[j].quality >= r.quality)
                if sum(n for x, n in rows if x >> k & 1 and not x & done) >= self.least_improved:
                    taken.append(k)
                    if sum(t == target for t, _ in self.rules) >= self.most_rules:
                        raise RuntimeError(f"more than {self.most_rules} rules")
                    self.rules.append((target, r))
            if taken:
                have = [F.when(part[j].applies(), F.lit(part[j].quality)) for j in taken]
                own = pinned(own.withColumn("_best", F.greatest("_best", *have)))

    def fit(self, df: DataFrame) -> RuleLearner:
        self.rules, self.extremes = [], {}
        cells = self.cells(df).withColumns({"_w": F.lit(1.0), "_best": F.lit(0.0)})
        counts = {r["_y"]: r["n"] for r in cells.groupBy("_y").agg(F.sum("_n").alias("n")).collect()}
        self.shares = {y: n / sum(counts.values()) for y, n in sorted(counts.items())}
        if self.covering == "ordered":
            self._cover(cells, list(self.shares))
            return self
        for target in self.shares if len(self.shares) > 1 else ():
            if self.measure == "evc":
                self.extremes[target] = self.fit_extremes(self.best_by_chance(cells, target))
            if self.covering == "probable":
                self._improving(cells.withColumn("_best", F.lit(self.shares[target])), target)
            else:
                self._cover(cells, [target])
        return self

    def _cover(self, cells: DataFrame, targets: list[str]) -> None:
        least = {"laplace": 0.5 if self.covering == "unordered" else 0.0, "wracc": 1e-3}.get(self.measure, 0.0)
        for _ in range(self.most_rules):
            found = self.best_rule(cells, targets)
            if found is None or found[1].quality <= max(least, 0.0 if self.measure in ("wracc", "laplace") else self.shares[found[0]]):
                return
            target, rule = found
            self.rules.append(found)
            own = F.col("_y") == target
            if self.covering == "ordered":
                cells = cells.where(~rule.applies())
            elif self.covering == "unordered":
                cells = cells.where(~(rule.applies() & own))
            else:
                cells = cells.withColumn("_w", F.when(rule.applies() & own, F.col("_w") * self.factor).otherwise(F.col("_w")))
            if len(self.rules) % 8 == 0:
                cells = pinned(cells)
        raise RuntimeError(f"more than {self.most_rules} rules")

    def transform(self, df: DataFrame) -> DataFrame:
        """With `prediction`: of an ordered list the first rule's class; else the class of the best rule, by the share of positives that is believed, the first class of equals; where none applies the most frequent class."""
        if not self.shares:
            return df.withColumn("prediction", F.lit(None).cast("string"))
        default = F.lit(max(self.shares, key=lambda y: self.shares[y]))
        if self.covering == "ordered":
            every = [F.when(r.applies(), F.lit(t)) for t, r in self.rules]
            return df.withColumn("prediction", F.coalesce(*every, default))
        votes = [F.when(r.applies(), F.struct(F.lit(-float(r.share)).alias("s"), F.lit(t).alias("t"))) for t, r in self.rules]
        return df.withColumn("prediction", F.coalesce(F.array_min(F.array(*votes))["t"], default) if votes else default)
