"""Learners of several 0/1 labels at once, over tables of nearest neighbours (probe, neighbour, d, rank)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binary_relevance(fit: Callable[[str], Callable], labels: Sequence[str]) -> Callable[[DataFrame], Callable[[DataFrame], DataFrame]]:
    """A learner for each label, on its own: `fit` makes it from the label's name. Predictions are named <label>_predicted."""

    def train(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
        models = {c: fit(c)(df) for c in labels}
        return lambda rows: reduce(lambda t, c: models[c](t).select(*t.columns, F.col("prediction").alias(f"{c}_predicted")), labels, rows)

    return train


def _positives(neighbours: DataFrame, table: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """(probe, k, and for each label how many of the neighbours have it)."""
    own = table.select(F.col(key).alias("neighbour"), *labels)
    return neighbours.select("probe", "neighbour").join(own, "neighbour").groupBy("probe").agg(F.count("*").alias("k"), *(F.sum(c).alias(c) for c in labels))


def br_knn(neighbours: DataFrame, table: DataFrame, key: str, labels: Sequence[str], extension: str = "") -> DataFrame:
    """(probe, share of each label among the neighbours, <label>_predicted).

    A label holds from one half on. Extension a: where none does, the label of the largest share (the first of equals) holds; b: the labels of
    the largest shares hold, as many as neighbours have on average.
    """
    t = _positives(neighbours, table, key, labels).select("probe", *((F.col(c) / F.col("k")).alias(c) for c in labels))
    if extension == "b":
        place = lambda c, k: sum((F.when((F.col(o) > F.col(c)) | ((F.col(o) == F.col(c)) & F.lit(j < k)), 1).otherwise(0) for j, o in enumerate(labels)), F.lit(0))
        size = F.floor(sum((F.col(c) for c in labels), F.lit(0.0)) + 0.5)
        return t.withColumns({f"{c}_predicted": (place(c, k) < size).cast("int") for k, c in enumerate(labels)})
    none = reduce(lambda a, b: a & b, (F.col(c) < 0.5 for c in labels))
    best = F.greatest(*labels) if len(labels) > 1 else F.col(labels[0])
    first = lambda k: reduce(lambda a, b: a & b, (F.col(o) < best for o in labels[:k]), F.lit(True))
    saved = lambda c, k: none & (F.col(c) == best) & first(k) if extension == "a" else F.lit(False)
    return t.withColumns({f"{c}_predicted": ((F.col(c) >= 0.5) | saved(c, k)).cast("int") for k, c in enumerate(labels)})


def ml_knn(train: DataFrame, probes: DataFrame, table: DataFrame, key: str, labels: Sequence[str], k: int, s: float = 1.0) -> DataFrame:
    """(probe, <label>: its posterior probability, <label>_predicted).

    `train` has the k neighbours of the training rows (themselves left out), `probes` those of the rows to predict, both
    among `table`. The prior of a label is (s + n1) / (2 s + n); the likelihood of j positive neighbours is (s + c[j]) / (s (k + 1) + sum of c), c
    counting training rows with the label (or without it) by j. These tables have k + 1 rows a label.
    """
    counts = _positives(train, table, key, labels).drop("k").join(table.select(F.col(key).alias("probe"), *(F.col(c).alias(f"_own_{c}") for c in labels)), "probe")
    out = _positives(probes, table, key, labels)
    n = table.count()
    for c in labels:
        seen = {(r[0], r[1]): r[2] for r in counts.groupBy(F.col(c).cast("int"), F.col(f"_own_{c}").cast("int")).count().collect()}
        ones = table.where(F.col(c) == 1).count()
        prior = (s + ones) / (2 * s + n)
        total = {b: sum(v for (_, own), v in seen.items() if own == b) for b in (0, 1)}
        chance = {b: [(s + seen.get((j, b), 0)) / (s * (k + 1) + total[b]) for j in range(k + 1)] for b in (0, 1)}
        p = [prior * chance[1][j] / (prior * chance[1][j] + (1 - prior) * chance[0][j]) for j in range(k + 1)]
        out = out.withColumn(f"_p_{c}", F.get(F.array(*map(F.lit, p)), F.col(c).cast("int")))
    return out.select("probe", *(x for c in labels for x in (F.col(f"_p_{c}").alias(c), (F.col(f"_p_{c}") >= 0.5).cast("int").alias(f"{c}_predicted"))))
