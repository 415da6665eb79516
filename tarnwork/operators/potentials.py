"""Prediction from a linear projection to the plane: classes (or numbers) by the potentials of all projected rows, without pairs of rows.

The plane is cut into squares, level by level. A pair of a target's and a source's square that lie far enough apart counts the source's rows at their centre of
weight; of near ones with few source points each point counts; the others go on to the next level. Neighbouring targets are a block, and a task: it gets the squares and
points that any of its targets may need, found by a join, and sums them up, so that no list of pairs leaves it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.relational import spread
from tarnwork.schema import values_of
from tarnwork.session import pinned

#: Squares have at least this share of the plane's width, 1 / 2^DEEPEST.
DEEPEST = 12

#: A block has at most so many targets.
MOST_TARGETS = 16384


def farthest_apart(law: str, error: float, h: float) -> int | None:
    """Least difference of places at which squares of side `h` may be taken as one point with at most this relative error, if any below 200.

    Around the centre of weight the first-order term vanishes and the mean square of distances is at most h^2 / 2; the second-order term is bounded by the law's largest second
    derivative at the gap kh, and the law itself by its value at the gap plus the diagonal.
    """
    for k in range(1, 200):
        gap = k * h
        if law == "inverse":
            bound = (1 + math.sqrt(2) / k) / (2 * k * k)
        elif law == "square":
            bound = 1.5 * (1 + math.sqrt(2) / k) ** 2 / (k * k)
        else:
            bound = h * h / 4 * max(1.0, 1 / gap) * math.exp(min(math.sqrt(2) * h, 700.0))
        if bound <= error and gap > 1e-4:
            return k + 1
    return None


def radial_anchors(names: Sequence[str]) -> list[tuple[float, float]]:
    """Columns' anchors evenly around the circle."""
    return [(math.cos(2 * math.pi * i / len(names)), math.sin(2 * math.pi * i / len(names))) for i in range(len(names))]


# -- squares: the number of one is a 1, then the bits of its place, x and y in turn; its parent's is a quarter of it -----------------------------


def _deepest(x: Column, y: Column) -> Column:
    """The number of the square of the last level at a place."""
    out = []
    for v in (x, y):
        v = F.least(F.greatest(v, F.lit(0)), F.lit(2**DEEPEST - 1)).cast("int")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        out.append(v)
    return out[0].bitwiseOR(F.shiftleft(out[1], 1)) + F.lit(4**DEEPEST)


def _places(squares: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    v = np.asarray(squares, np.int64) - 4**level
    return tuple(sum(((v >> (2 * i + k)) & 1) << i for i in range(level + 1)) for k in (0, 1))


def _number(x: np.ndarray, y: np.ndarray, level: int) -> np.ndarray:
    return 4**level + sum((((x >> i) & 1) << (2 * i)) | (((y >> i) & 1) << (2 * i + 1)) for i in range(level + 1))


def _ends(deepest: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The first square around each place that is not among `more`, the deepest at last."""
    out, going = np.asarray(deepest, np.int64).copy(), np.ones(len(deepest), bool)
    for level in range(DEEPEST):
        square = deepest >> 2 * (DEEPEST - level)
        stop = going & ~np.isin(square, more)
        out[stop] = square[stop]
        going &= ~stop
    return out


def _full(df: DataFrame, most: int) -> np.ndarray:
    """The squares with more rows than that, a row each: there are at most so many times fewer than rows, and 4^DEEPEST in a level."""
    every = F.explode(F.array(*(F.shiftright("_at", 2 * (DEEPEST - level)) for level in range(DEEPEST + 1)))).alias("_square")
    found = df.select(every).groupBy("_square").agg(F.count("*").alias("n")).where(F.col("n") > most).select("_square").toPandas()
    return np.sort(found["_square"].to_numpy(np.int32))


def _ended(df: DataFrame, more: np.ndarray, name: str) -> DataFrame:
    """With the square at which each row's way down ends."""
    end = F.pandas_udf(lambda at: pd.Series(_ends(at.to_numpy(), more)), "int")
    return df.withColumn(name, end("_at"))


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    n = stop - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def _block_sums(t: pd.DataFrame, s: pd.DataFrame, channels: int, law: str, numeric: bool, apart: list[int | None], few: int) -> pd.DataFrame:
    """Sums of a block's targets over its squares (rows with `_k`, their count) and points (without): down the levels, by the targets of one square at a time."""
    t, s = t.sort_values("_at"), s.sort_values(["_square", "_j"])
    at, tx, ty = t["_at"].to_numpy(np.int64), t["tx"].to_numpy(), t["ty"].to_numpy()
    out = np.zeros((len(t), channels))
    points, squares = s[s["_k"] == 0], s[s["_k"] > 0]
    where = points["_square"].to_numpy(np.int64)
    number, first = np.unique(squares["_square"].to_numpy(np.int64), return_index=True)
    last, count = np.append(first[1:], len(squares)), squares["_k"].to_numpy()[first]
    given = [(g["x"].to_numpy(), g["y"].to_numpy(), g["w"].to_numpy()[:, None] * (g["_j"].to_numpy()[:, None] == np.arange(channels))) for g in (squares, points)]

    def add(low: int, high: int, of: tuple[np.ndarray, ...], rows: np.ndarray) -> None:
        for begin in range(0, len(rows), 4096):
            x, y, w = (v[rows[begin : begin + 4096]] for v in of)
            step = max(1, 2**16 // len(x))
            for a in range(low, high, step):
                b = min(a + step, high)
                r2, dy = np.subtract.outer(tx[a:b], x), np.subtract.outer(ty[a:b], y)
                r2 *= r2
                dy *= dy
                r2 += dy
                if law == "exponential":
                    f = np.exp(-np.sqrt(r2))
                    if numeric:
                        f[r2 < 1e-8] = 1e4
                else:  # the law at 1e-4 is what points closer than that weigh
                    np.maximum(r2, 1e-8, out=r2)
                    f = np.reciprocal(r2 if law == "square" else np.sqrt(r2, out=r2), out=r2)
                out[a:b] += f @ w

    going = [(0, 0, len(t), np.arange(np.searchsorted(number, 2)))]
    while going:
        level, low, high, pairs = going.pop()
        (ax, ay), (bx, by) = (_places(v, level) for v in (at[low : low + 1] >> 2 * (DEEPEST - level), number[pairs]))
        far = np.maximum(np.abs(ax - bx), np.abs(ay - by)) >= (apart[level] or np.inf)
        add(low, high, given[0], _ranges(first[pairs[far]], last[pairs[far]]))
        near = pairs[~far]
        few_here = (count[near] <= few) | (level == DEEPEST)
        ended, more = number[near[few_here]], number[near[~few_here]]
        add(low, high, given[1], _ranges(np.searchsorted(where, ended), np.searchsorted(where, ended, "right")))
        if len(more):
            kids = _ranges(np.searchsorted(number, 4 * more), np.searchsorted(number, 4 * more + 4))
            edges = [low, *(low + 1 + np.flatnonzero(np.diff(at[low:high] >> 2 * (DEEPEST - level - 1)))), high]
            going += [(level + 1, a, b, kids) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pd.DataFrame({"tx": tx, "ty": ty} | {f"w{j}": out[:, j] for j in range(channels)})


@dataclass
class Potentials:
    """`law` of the distance r: inverse (1 / r), square (1 / r^2), exponential (e^-r). Points closer than 1e-4 weigh 1e4, 1e8 and, of numbers, 1e4.

    A row's point is the sum of its values, each from 0 at the training rows' least to 1 at their greatest, times the anchors; `normalize`
    divides by the values' sum weighted by the anchors' lengths, where that is above 0. An unknown value (null, NaN) counts as the mean, a constant column as 0. `error` bounds each potential's relative error (0: every pair of points is
    computed). Rows of unknown target do not train. With `numeric` the prediction is the mean of the target weighted by potential (0 if they sum to 1e-4 or less); else the class of the largest, the first of equals.
    Of an empty table, null.
    """

    names: Sequence[str]
    target: str
    anchors: Sequence[tuple[float, float]] = ()
    law: str = "inverse"
    numeric: bool = False
    normalize: bool = True
    error: float = 0.02
    few: int = 64
    classes: list[str] = field(default_factory=list)
    scales: list[tuple[float, float, float]] = field(default_factory=list)
    points: DataFrame | None = None
    apart: list[int | None] = field(default_factory=list)  # by level, where squares are far

    def _channels(self) -> dict[str, Column]:
        """Weights of a row, none below 0: by class; of numbers 1, what is above 0 and what is below."""
        y = F.col("_y")
        if self.numeric:
            return {"w0": F.lit(1.0), "w1": F.greatest(y, F.lit(0.0)), "w2": F.greatest(-y, F.lit(0.0))}
        return {f"w{j}": (y == c).cast("double") for j, c in enumerate(self.classes)}

    def project(self, df: DataFrame) -> DataFrame:
        """With the point of each row, `_px` and `_py`."""
        z = []
        for c, (low, span, mean) in zip(self.names, self.scales, strict=True):
            v = F.col(c).cast("double")
            z.append((F.coalesce(F.when(~F.isnan(v), v), F.lit(mean)) - low) / span)
        x, y = (sum((v * a[k] for v, a in zip(z, self.anchors, strict=True)), F.lit(0.0)) for k in (0, 1))
        if self.normalize:
            total = sum((v * math.hypot(*a) for v, a in zip(z, self.anchors, strict=True)), F.lit(0.0))
            x, y = (F.when(total > 0, p / total).otherwise(p) for p in (x, y))
        return df.withColumns({"_px": x, "_py": y})

    def fit(self, df: DataFrame) -> Potentials:
        if self.law not in ("inverse", "square", "exponential"):
            raise ValueError(f"no law {self.law}")
        self.anchors = list(self.anchors) or radial_anchors(self.names)
        y = F.col(self.target).cast("double" if self.numeric else "string")
        rows = df.withColumn("_y", F.when(~F.isnan(y), y) if self.numeric else y).where("_y is not null")
        self.classes = [] if self.numeric else values_of(rows, "_y")["_y"]
        known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in self.names}
        r = rows.agg(F.lit(0), *(f(v).alias(f"{p}{i}") for i, v in enumerate(known.values()) for p, f in (("a", F.min), ("b", F.max), ("m", F.avg)))).first()
        self.scales = []
        for i in range(len(self.names)):
            low, high, mean = (r[f"{p}{i}"] for p in "abm")
            self.scales.append((0.0, 1.0, 0.0) if low is None else (low, high - low if high > low else 1.0, mean))
        channels = self._channels()
        at = self.project(rows).select("_px", "_py", *(w.alias(n) for n, w in channels.items()))
        at = at.withColumnsRenamed({"_px": "sx", "_py": "sy"})
        self.points = pinned(at.groupBy("sx", "sy").agg(*(F.sum(n).alias(n) for n in channels)) if channels else at)
        return self

    def _law(self, r2: Column) -> Column:
        near = r2 < 1e-8
        if self.law == "inverse":
            return F.when(near, 1e4).otherwise(1 / F.sqrt(r2))
        if self.law == "square":
            return F.when(near, 1e8).otherwise(1 / r2)
        return F.when(near, 1e4).otherwise(F.exp(-F.sqrt(r2))) if self.numeric else F.exp(-F.sqrt(r2))

    def _sums(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        """By target point, from the squares and points that each block needs."""
        names, law, numeric, few, apart = self._names(), self.law, self.numeric, self.few, self.apart
        parts = 4 * targets.sparkSession.sparkContext.defaultParallelism
        here, there = (d.repartition(parts, "_block", "_part").groupBy("_block", "_part") for d in (targets, sources))
        return here.cogroup(there).applyInPandas(lambda t, s: _block_sums(t, s, len(names), law, numeric, apart, few), ", ".join(f"{n} double" for n in ("tx", "ty", *names)))

    def _every_pair(self, targets: DataFrame) -> DataFrame:
        sums = [F.sum(F.col(n) * self._law((F.col("tx") - F.col("sx")) ** 2 + (F.col("ty") - F.col("sy")) ** 2)).alias(n) for n in self._names()]
        return targets.crossJoin(self.points).groupBy("tx", "ty").agg(*sums)

    def _names(self) -> list[str]:
        return [f"w{j}" for j in range(3 if self.numeric else len(self.classes))]

    def potentials(self, targets: DataFrame) -> DataFrame:
        """(tx, ty, w0, w1, ...) of the different points (tx, ty)."""
        names = self._names()
        box = lambda t, x, y: t.agg(F.min(x).alias("ax"), F.max(x).alias("bx"), F.min(y).alias("ay"), F.max(y).alias("by"))
        targets = pinned(targets.select("tx", "ty").where("tx is not null and ty is not null").distinct())
        b = box(targets, "tx", "ty").unionByName(box(self.points, "sx", "sy")).agg(F.min("ax"), F.max("bx"), F.min("ay"), F.max("by")).first()
        if not names or self.points.isEmpty() or targets.isEmpty():
            return targets.select("tx", "ty", *(F.lit(None).cast("double").alias(n) for n in names))
        if self.error <= 0:
            return self._every_pair(targets)
        side = max(b[1] - b[0], b[3] - b[2], 1e-9) * (1 + 1e-9)
        at = lambda x, y: _deepest(F.floor((F.col(x) - b[0]) / side * 2**DEEPEST), F.floor((F.col(y) - b[2]) / side * 2**DEEPEST)).alias("_at")
        t, s = spread(targets.select("tx", "ty", at("tx", "ty"))), spread(self.points.select("sx", "sy", *names, at("sx", "sy")))
        self.apart = [farthest_apart(self.law, self.error, side / 2**level) for level in range(DEEPEST + 1)]
        reach = [1]  # pairs of a level are less than this apart, if their parents were near
        for k in self.apart[1:]:
            reach.append(min(k or 2**DEEPEST, 2 * reach[-1]))

        cores = t.sparkSession.sparkContext.defaultParallelism
        size = min(max(t.count() // (8 * cores), 256), MOST_TARGETS)
        t = _ended(t, _full(t, size), "_block")
        blocks = pinned(t.groupBy("_block").agg(F.ceil(F.count("*") / size).cast("int").alias("_parts")))  # a row for each `size` targets or so; one of the last level is dealt to parts
        t = t.join(blocks, "_block").withColumn("_part", F.pmod(F.xxhash64("tx", "ty"), F.col("_parts")).cast("int")).drop("_parts")
        more = _full(s, self.few)
        deepest = min((int(more[-1]).bit_length() + 1) // 2, DEEPEST) if len(more) else 0

        def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The squares around each block of which it needs the squares (kind 1) and points (kind 0) of each level."""
            for rows in batches:
                for block, parts in zip(rows["_block"], rows["_parts"], strict=True):
                    own = (int(block).bit_length() - 1) // 2
                    x, y = _places(np.array([block]), own)
                    for kind in (0, 1):
                        for level in range(deepest + 1):
                            q = max(level - kind, 0)  # where the pair was near: points themselves, squares by their parents
                            m = min(q, own)
                            r = -(-(reach[q] - 1) // 2 ** (q - m))
                            gx, gy = (np.arange(max(int(v[0] >> (own - m)) - r, 0), min(int(v[0] >> (own - m)) + r, 2**m - 1) + 1) for v in (x, y))
                            around = _number(*(g.ravel() for g in np.meshgrid(gx, gy)), m)
                            for part in range(parts):
                                yield pd.DataFrame({"_kind": kind, "_level": level, "_around": around, "_block": block, "_part": part})

        levels = sorted({(r["_block"].bit_length() - 1) // 2 for r in blocks.select("_block").collect()})
        wanted = spread(blocks).mapInPandas(asked, "_kind int, _level int, _around int, _block int, _part int")
        s = pinned(_ended(s, more, "_end").withColumn("_last", F.expr("cast((length(bin(_end)) - 1) / 2 as int)")))
        way = F.explode(F.expr(f"transform(sequence(0, _last), l -> struct(l as _level, shiftright(_at, 2 * ({DEEPEST} - l)) as _square))")).alias("_of")
        centre = [F.sum(F.col(n) * F.col(c)).alias(f"{c}_{n}") for n in names for c in ("sx", "sy")]
        squares = s.select("sx", "sy", *names, way).groupBy("_of._level", "_of._square").agg(F.count("*").alias("_k"), *(F.sum(n).alias(n) for n in names), *centre)
        each = lambda x, y: F.explode(F.filter(F.array(*(F.struct(F.lit(j).alias("_j"), F.col(n).alias("w"), x(n).alias("x"), y(n).alias("y")) for j, n in enumerate(names))), lambda v: v["w"] > 0)).alias("_of")
        squares = squares.select(F.lit(1).alias("_kind"), "_level", "_square", "_k", each(lambda n: F.try_divide(f"sx_{n}", n), lambda n: F.try_divide(f"sy_{n}", n)))
        points = s.select(F.lit(0).alias("_kind"), F.col("_last").alias("_level"), F.col("_end").alias("_square"), F.lit(0).cast("long").alias("_k"), each(lambda n: F.col("sx"), lambda n: F.col("sy")))
        q = "greatest(_level - _kind, 0)"
        keys = F.explode(F.expr(f"transform(filter(array_distinct(array({', '.join(f'least({m}, {q})' for m in levels)}, {q})), m -> m <= {q}), m -> shiftright(_square, 2 * (_level - m)))")).alias("_around")
        sources = squares.unionByName(points).select("_kind", "_level", "_square", "_k", "_of.*", keys).join(wanted, ["_kind", "_level", "_around"])
        return self._sums(sources.select("_block", "_part", "_square", "_k", "_j", "w", "x", "y"), t)

    def transform(self, df: DataFrame) -> DataFrame:
        """With `prediction`, and of classes `probability` in the order of `classes`."""
        rows = self.project(df)
        found = self.potentials(rows.select(F.col("_px").alias("tx"), F.col("_py").alias("ty")))
        names = [c for c in found.columns if c.startswith("w")]
        if self.numeric:
            mean = F.when(F.col("w0").isNull(), F.lit(None)).when(F.col("w0") > 1e-4, (F.col("w1") - F.col("w2")) / F.col("w0")).otherwise(0.0)
            said = {"prediction": mean.cast("double")}
        elif not names:
            return df.withColumns({"prediction": F.lit(None).cast("string"), "probability": F.array().cast("array<double>")})
        else:
            total = sum((F.col(n) for n in names), F.lit(0.0))
            p = F.array(*(F.col(n) / total for n in names))
            classes = F.from_json(F.lit(json.dumps(self.classes)), "array<string>")
            said = {"prediction": F.get(classes, (F.array_position(p, F.array_max(p)) - 1).cast("int")), "probability": p}
        found = found.select(F.col("tx").alias("_px"), F.col("ty").alias("_py"), *(v.alias(n) for n, v in said.items()))
        return rows.join(found, ["_px", "_py"], "left").select(*df.columns, *said)
