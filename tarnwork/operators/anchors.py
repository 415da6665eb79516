"""Linear projections to the plane that separate classes: anchors moved by attraction within classes and repulsion between them, and anchors by signal to noise.

No pairs of rows are made. Rows' weights are dealt to the four nodes around them on a grid over the plane, so that a row of numbers for each occupied cell is all that
leaves the aggregation; the potentials on the grid are convolutions of these, and each row feels the slope between its four nodes. The energy of the grid is thus exactly
the one whose slope moves the anchors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.potentials import Potentials, radial_anchors
from tarnwork.schema import values_of
from tarnwork.session import pinned

LAWS = ("linear", "square", "gaussian", "nearest", "linear_plus")


def pair_energy(law: str, r2: np.ndarray, soft: float, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """(attraction, repulsion) of two rows at squared distance r2.

    The forces are their slopes: linear r and 1 / r, square r^2 and 1 / r^2, gaussian r and r / (e^(r^2 / sigma) - 1), nearest r^2 e^(-r^2 / sigma) both, linear_plus r both.
    Repulsions that grow without bound as rows meet take r^2 + soft^2 for r^2.
    """
    r, near = np.sqrt(r2), r2 + soft * soft
    bump = np.sqrt(np.pi) / 4 * sigma**1.5 * np.vectorize(math.erf, otypes=[float])(r / math.sqrt(sigma)) - sigma / 2 * r * np.exp(-r2 / sigma)
    return {
        "linear": (r2 / 2, -np.log(near) / 2),
        "square": (r2 * r / 3, near**-0.5),
        "gaussian": (r2 / 2, -sigma / 2 * np.log(-np.expm1(-near / sigma))),
        "nearest": (bump, -bump),
        "linear_plus": (r2 / 2, -r2 / 2),
    }[law]


@dataclass
class FreeViz:
    """Anchors of columns in the plane. A row's point is the sum of its values, each from 0 to 1, times the anchors; `normalize` divides it by the values' sum weighted by the anchors' lengths.

    Rows of one class attract, rows of different classes repel each other, with `attract` and `repel` times the forces of `law` (see pair_energy); of a numeric target
    all rows repel, by the squared difference of their targets. Anchors go down the energy's slope, none by more than a tenth, then move so that their mean is 0 and
    the longest has length 1; a move that would raise the energy is halved. `restrain` keeps them on the circle ("circle") or on their first directions ("radius").
    Steps end when no move of `least` lowers the energy by a 10^-6th of its size (then `converged`) or after `steps` moves. In the end the first anchor lies on the right, the second above.

    The grid has cells x cells squares over the plane that points can be in; rows closer than two squares (`soft`) repel less than the law says, as rows that meet don't at all.
    Of 128 squares the energy differs from the sum over pairs of the softened law by less than 1 % in the tests.

    Rows with an unknown value or class take no part in the fit. Of an empty table, or no repulsion nor attraction, anchors stay where they begin: evenly around the circle, or as given.
    """

    names: Sequence[str]
    target: str
    law: str = "linear"
    numeric: bool = False
    attract: float = 1.0
    repel: float = 1.0
    sigma: float = 1.0
    normalize: bool = True
    restrain: str = ""
    cells: int = 128
    steps: int = 60
    least: float = 0.01
    anchors: list[tuple[float, float]] = field(default_factory=list)
    scales: list[tuple[float, float, float]] = field(default_factory=list)
    energies: list[float] = field(default_factory=list)
    converged: bool = False

    def _prepared(self, df: DataFrame) -> tuple[DataFrame, int]:
        """Rows as v0, v1, ... (0 to 1) and c (place of the class) or y (standardized), in the shared folder; and the number of channels."""
        x = [F.col(n).cast("double") for n in self.names]
        t = F.col(self.target).cast("double" if self.numeric else "string")
        rows = df.select(*(F.when(~F.isnan(v), v).alias(f"v{i}") for i, v in enumerate(x)), (F.when(~F.isnan(t), t) if self.numeric else t).alias("t")).dropna()
        ends = rows.agg(F.lit(0), *(f(f"v{i}").alias(f"{p}{i}") for i in range(len(x)) for p, f in (("a", F.min), ("b", F.max), ("m", F.avg))), *((F.avg("t").alias("m"), F.stddev_pop("t").alias("s")) if self.numeric else ())).first()
        self.scales = [(0.0, 1.0, 0.0) if ends[f"a{i}"] is None else (ends[f"a{i}"], (ends[f"b{i}"] - ends[f"a{i}"]) or 1.0, ends[f"m{i}"]) for i in range(len(x))]
        scaled = [((F.col(f"v{i}") - low) / span).alias(f"v{i}") for i, (low, span, _) in enumerate(self.scales)]
        if self.numeric:
            return pinned(rows.select(*scaled, ((F.col("t") - (ends["m"] or 0.0)) / (ends["s"] or 1.0)).alias("y"))), 3
        classes = values_of(rows, "t")["t"]
        return pinned(rows.select(*scaled, (F.array_position(F.array(*map(F.lit, classes)) if classes else F.array().cast("array<string>"), F.col("t")) - 1).cast("int").alias("c"))), len(classes)

    def _weights(self, channels: int) -> list[Column]:
        return [F.lit(1.0), F.col("y"), F.col("y") * F.col("y")] if self.numeric else [(F.col("c") == k).cast("double") for k in range(channels)]

    def _placed(self, rows: DataFrame, anchors: np.ndarray, width: float) -> DataFrame:
        """With the point (px, py), the divisor s, the cell (gx, gy) and the place (fx, fy) in it."""
        lengths = np.hypot(*anchors.T)
        dot = lambda w: sum((F.col(f"v{i}") * float(a) for i, a in enumerate(w)), F.lit(0.0))
        rows = rows.withColumn("s", F.when(dot(lengths) > 1e-6, dot(lengths)).otherwise(1.0) if self.normalize else F.lit(1.0))
        rows = rows.withColumns({"px": dot(anchors[:, 0]) / F.col("s"), "py": dot(anchors[:, 1]) / F.col("s")})
        at = {f"_{a}": (F.col(f"p{a}") + width) / (2 * width) * self.cells for a in "xy"}
        rows = rows.withColumns(at).withColumns({f"g{a}": F.greatest(F.least(F.floor(f"_{a}").cast("int"), F.lit(self.cells - 1)), F.lit(0)) for a in "xy"})
        return rows.withColumns({f"f{a}": F.col(f"_{a}") - F.col(f"g{a}") for a in "xy"}).drop("_x", "_y")

    def _dealt(self, placed: DataFrame, channels: int) -> np.ndarray:
        """Weights on the grid's nodes, (channel, x, y): one aggregation, a row for each occupied cell."""
        parts = {"o": F.lit(1.0), "x": F.col("fx"), "y": F.col("fy"), "z": F.col("fx") * F.col("fy")}
        sums = [F.sum(w * v).alias(f"{p}{k}") for k, w in enumerate(self._weights(channels)) for p, v in parts.items()]
        found = placed.groupBy("gx", "gy").agg(*sums).toPandas()  # cells x cells rows at most
        out = np.zeros((channels, self.cells + 1, self.cells + 1))
        gx, gy = found["gx"].to_numpy(int), found["gy"].to_numpy(int)
        for k in range(channels):
            o, x, y, z = (found[f"{p}{k}"].to_numpy(float) for p in "oxyz")
            for i, j, w in ((0, 0, o - x - y + z), (1, 0, x - z), (0, 1, y - z), (1, 1, z)):
                np.add.at(out[k], (gx + i, gy + j), w)
        return out

    def _fields(self, dealt: np.ndarray, n: int, width: float) -> tuple[float, np.ndarray]:
        """The energy of a pair on average, and each channel's potential on the nodes."""
        m, h = self.cells + 1, 2 * width / self.cells
        k = np.minimum(np.arange(2 * m), 2 * m - np.arange(2 * m)) * h
        near, apart = (np.fft.rfft2(e) for e in pair_energy(self.law, k[:, None] ** 2 + k[None] ** 2, 2 * h, self.sigma))
        spectra = np.fft.rfft2(dealt / n, (2 * m, 2 * m))
        back = lambda f: np.fft.irfft2(f, (2 * m, 2 * m))[..., :m, :m]
        if self.numeric:
            one, y, yy = (back(self.repel * apart * s) for s in spectra)
            fields = np.stack([yy, -2 * y, one])
        else:
            fields = back(self.attract * near * spectra + self.repel * apart * (spectra.sum(0) - spectra))
        return float((dealt / n * fields).sum() / 2), fields

    def _slope(self, placed: DataFrame, fields: np.ndarray, anchors: np.ndarray, dealt: np.ndarray, n: int, width: float) -> np.ndarray:
        """The energy's slope by anchor: the occupied cells' differences of potential go to their rows, and a row of sums comes back."""
        h, (channels, m, _) = 2 * width / self.cells, fields.shape
        there = np.abs(dealt).sum(0)
        gx, gy = np.nonzero(there[:-1, :-1] + there[1:, :-1] + there[:-1, 1:] + there[1:, 1:])
        a, b, c, d = (fields[:, gx + i, gy + j].T / h for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)))
        spark = placed.sparkSession
        cells = spark.createDataFrame([(int(i), int(j), *map(list, r)) for i, j, *r in zip(gx, gy, (b - a).tolist(), (d - c).tolist(), (c - a).tolist(), (d - b).tolist(), strict=True)], "gx int, gy int, x0 array<double>, x1 array<double>, y0 array<double>, y1 array<double>")
        here = placed.join(F.broadcast(cells), ["gx", "gy"])  # at most cells x cells rows
        pick = (lambda a: sum((w * F.get(a, F.lit(k)) for k, w in enumerate(self._weights(channels))), F.lit(0.0))) if self.numeric else (lambda a: F.get(a, F.col("c")))
        here = here.select("*", (pick("x0") * (1 - F.col("fy")) + pick("x1") * F.col("fy")).alias("dx"), (pick("y0") * (1 - F.col("fx")) + pick("y1") * F.col("fx")).alias("dy"))
        along = {"x": F.col("dx"), "y": F.col("dy"), "r": F.col("dx") * F.col("px") + F.col("dy") * F.col("py")}
        r = here.agg(*(F.sum(F.col(f"v{i}") / F.col("s") * v).alias(f"{p}{i}") for i in range(len(self.names)) for p, v in along.items())).first()
        slope = np.array([[r[f"x{i}"], r[f"y{i}"]] for i in range(len(self.names))], float)
        if self.normalize:
            lengths = np.hypot(*anchors.T)
            slope -= np.array([r[f"r{i}"] for i in range(len(self.names))], float)[:, None] * anchors / np.where(lengths > 1e-12, lengths, 1)[:, None]
        return slope / n

    def _moved(self, anchors: np.ndarray, by: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.restrain == "circle":
            out = anchors + by
            return out / np.maximum(np.hypot(*out.T), 1e-12)[:, None]
        if self.restrain == "radius":
            out = first * np.maximum(((anchors + by) * first).sum(1), 0)[:, None]
        else:
            out = anchors + by
            out = out - out.mean(0)
        longest = np.hypot(*out.T).max()
        return out / longest if longest > 1e-6 else anchors

    def fit(self, df: DataFrame) -> FreeViz:
        if self.law not in LAWS or self.restrain not in ("", "circle", "radius"):
            raise ValueError(f"no law {self.law} or restraint {self.restrain}")
        anchors = np.array(self.anchors or radial_anchors(self.names), float)
        rows, channels = self._prepared(df)
        n = rows.count()
        if n and channels and len(self.names) > 1:
            lengths = np.maximum(np.hypot(*anchors.T), 1e-12)
            anchors = self._descended(rows, channels, n, anchors, anchors / lengths[:, None])
        self.anchors = [tuple(map(float, a)) for a in _turned(anchors)]
        return self

    def _descended(self, rows: DataFrame, channels: int, n: int, anchors: np.ndarray, first: np.ndarray) -> np.ndarray:
        whole = sum((F.col(f"v{i}") for i in range(len(self.names))), F.lit(0.0))
        width = 1.0 if self.normalize else max(float(rows.agg(F.max(whole)).first()[0]), 1e-9)

        def state(at: np.ndarray) -> tuple[float, np.ndarray, DataFrame, np.ndarray]:
            placed = self._placed(rows, at, width)
            dealt = self._dealt(placed, channels)
            energy, fields = self._fields(dealt, n, width)
            return energy, fields, placed, dealt

        now, step, moves = state(anchors), 0.1, 0
        self.energies = [now[0]]
        while moves < self.steps:
            down = -self._slope(now[2], now[1], anchors, now[3], n, width)
            if self.restrain == "circle":
                down -= (down * anchors).sum(1)[:, None] * anchors
            elif self.restrain == "radius":
                down = (down * first).sum(1)[:, None] * first
            longest = np.hypot(*down.T).max()
            while longest > 1e-12 and step >= self.least:
                then = self._moved(anchors, down * (step / longest), first)
                found = state(then)
                if found[0] < now[0] - 1e-6 * abs(now[0]):
                    break
                step /= 2
            else:
                self.converged = True
                break
            anchors, now, step, moves = then, found, min(0.1, 2 * step), moves + 1
            self.energies.append(now[0])
        return anchors

    def projected(self, df: DataFrame) -> DataFrame:
        """With each row's point, `px` and `py`; an unknown value counts as the mean of the rows that were fitted."""
        m = Potentials(self.names, self.target, self.anchors, numeric=self.numeric, normalize=self.normalize, scales=self.scales)
        return m.project(df).withColumnsRenamed({"_px": "px", "_py": "py"})

    def classifier(self, df: DataFrame, law: str = "square") -> Potentials:
        """Prediction by the potentials of the projected rows."""
        return Potentials(self.names, self.target, self.anchors, law=law, numeric=self.numeric, normalize=self.normalize).fit(df)


def _turned(anchors: np.ndarray) -> np.ndarray:
    """Turned so that the first lies on the right, and mirrored so that the second is not below."""
    if not len(anchors):
        return anchors
    turn = math.atan2(anchors[0, 1], anchors[0, 0])
    c, s = math.cos(turn), math.sin(turn)
    out = anchors @ np.array([[c, -s], [s, c]])
    return out * [1, -1] if len(out) > 1 and out[1, 1] < -1e-9 else out


# -- signal to noise --------------------------------------------------------------------


def _by_class(df: DataFrame, names: Sequence[str], class_name: str) -> DataFrame:
    """(attribute, class, n, s, q): count, sum and sum of squares of known values, in one scan."""
    long = df.where(F.col(class_name).isNotNull()).select(F.col(class_name).cast("string").alias("class"), *(F.col(c).cast("double").alias(c) for c in names)).unpivot("class", list(names), "attribute", "x")
    x = F.when(~F.isnan("x"), F.col("x"))
    return long.groupBy("attribute", "class").agg(F.count(x).cast("double").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q")).where("n > 0")


def _deviation(n: Column, s: Column, q: Column) -> Column:
    return F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))


def signal_to_noise(df: DataFrame, names: Sequence[str], class_name: str) -> DataFrame:
    """(attribute, s2n): over pairs of classes, the sum of their means' difference by the sum of their deviations; pairs without deviation, and classes without known values, give nothing."""
    t = _by_class(df, names, class_name).select("attribute", "class", (F.col("s") / F.col("n")).alias("m"), _deviation(F.col("n"), F.col("s"), F.col("q")).alias("d"))
    a, b = t.alias("a"), t.alias("b")
    term = F.when(F.col("a.d") + F.col("b.d") > 0, F.abs(F.col("a.m") - F.col("b.m")) / (F.col("a.d") + F.col("b.d")))
    both = a.join(b, (F.col("a.attribute") == F.col("b.attribute")) & (F.col("a.class") <= F.col("b.class")))  # a row per class: few
    return both.groupBy(F.col("a.attribute").alias("attribute")).agg(F.coalesce(F.sum(F.when(F.col("a.class") < F.col("b.class"), term)), F.lit(0.0)).alias("s2n"))


def signal_by_class(df: DataFrame, names: Sequence[str], class_name: str) -> DataFrame:
    """(attribute, class, s2n): the class against all others taken together; below 0 where its mean is not the highest of all classes' means."""
    t = _by_class(df, names, class_name)
    whole = t.groupBy("attribute").agg(*(F.sum(c).alias(f"a{c}") for c in "nsq"), F.max(F.col("s") / F.col("n")).alias("top"))
    t = t.join(whole, "attribute")
    n, s, q = (F.col(f"a{c}") - F.col(c) for c in "nsq")
    own, rest = F.col("s") / F.col("n"), F.try_divide(s, n)
    d = _deviation(F.col("n"), F.col("s"), F.col("q")) + F.when(n > 0, F.sqrt(F.greatest(F.try_divide(q, n) - rest * rest, F.lit(0.0))))
    value = F.coalesce(F.when(d > 0, F.abs(own - rest) / d), F.lit(0.0))
    return t.select("attribute", "class", F.when(own < F.col("top"), -value).otherwise(value).alias("s2n"))


def noise_anchors(df: DataFrame, names: Sequence[str], class_name: str, most: int = 50, spread: float = 5.0) -> dict[str, tuple[float, float]]:
    """Anchors by signal to noise: classes choose the column that tells them best in turn, and have theirs around their own place on the circle, the best in the middle.

    Of `most` columns each class gets as many; `spread` is the share, in tenths, of the circle that columns take. Ties go to the later name, as in descending order. Columns without known values are left out.
    """
    found = signal_by_class(df, names, class_name).collect()  # a row per column and class
    classes = sorted({r["class"] for r in found})
    ranked = {c: sorted(((r["s2n"], r["attribute"]) for r in found if r["class"] == c), reverse=True) for c in classes}
    order, taken, columns = [], set(), {r["attribute"] for r in found}
    while len(order) < len(columns):
        for c in classes:
            pick = next((a for _, a in ranked[c] if a not in taken), None)
            if pick is not None:
                order.append(pick)
                taken.add(pick)
        if not any(a not in taken for c in classes for _, a in ranked[c]):
            break
    order = order[: most // len(classes) * len(classes)] if classes else []
    out = {}
    for k, c in enumerate(classes):
        for i, a in enumerate(order[k :: len(classes)]):
            off = (i + 1) // 2 * (1 if i % 2 else -1)
            angle = 2 * math.pi * k / len(classes) + off * 2 * math.pi * spread / (10 * len(order))
            out[a] = (math.cos(angle), math.sin(angle))
    return out
