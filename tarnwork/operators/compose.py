"""Learners made of learners, and experiments with them.

A learner is a function from training rows to a function that adds `prediction` (and what else it gives) to rows; a preprocessor is a
function from rows to rows. What is tried out (parameters, sets of columns, folds) is a loop on the driver; each try is a Spark job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.operators import learn
from tarnwork.operators.evaluate import cross_validate
from tarnwork.operators.relational import numbered, running
from tarnwork.operators.sampling import subset_two, uniform

Predict = Callable[[DataFrame], DataFrame]
Learner = Callable[[DataFrame], Predict]

#: Rows of a leave-one-out experiment, which trains as often; more are an error.
MOST_LEFT_OUT = 1000


# -- preprocessing -----------------------------------------------------------------------


def preprocessors(*steps: Predict) -> Predict:
    """One after another."""
    return lambda df: reduce(lambda rows, f: f(rows), steps, df)


def preprocessed(learner: Learner, *steps: Predict) -> Learner:
    """A learner whose training rows, and the rows it predicts, go through the steps first."""
    prepare = preprocessors(*steps)

    def fit(train: DataFrame) -> Predict:
        predict = learner(prepare(train))
        return lambda rows: predict(prepare(rows))

    return fit


# -- simple learners in this form ----------------------------------------------------------


def majority(class_name: str) -> Learner:
    def fit(train: DataFrame) -> Predict:
        best = learn.majority(train, class_name).select("prediction")
        return lambda rows: rows.join(F.broadcast(best))  # one row

    return fit


def random_class(class_name: str, order: Sequence[str], seed: int = 0) -> Learner:
    """A class drawn with its share, by each row's key. Classes are few."""

    def fit(train: DataFrame) -> Predict:
        counts = sorted((r[0], r[1]) for r in train.where(F.col(class_name).isNotNull()).groupBy(class_name).count().collect())
        total, upto, e = sum(n for _, n in counts), 0, None
        for c, n in counts:
            upto += n
            test = uniform(order, seed) < upto / total
            e = F.when(test, F.lit(c)) if e is None else e.when(test, F.lit(c))
        return lambda rows: rows.withColumn("prediction", e)

    return fit


def naive_bayes(names: Sequence[str], class_name: str, m: float = 2.0) -> Learner:
    """With p, the probability of the last class."""

    def fit(train: DataFrame) -> Predict:
        model = learn.NaiveBayes(names, class_name, m).fit(train)
        return lambda rows: model.transform(rows).withColumn("p", F.element_at("probability", -1)).drop("probability")

    return fit


def from_column(value: Column) -> Learner:
    """A model that is an expression, whatever the training rows."""
    return lambda train: lambda rows: rows.withColumn("prediction", value)


def targets(learners: dict[str, Learner]) -> Learner:
    """A model for each of several targets; predictions are named <target>_predicted."""

    def fit(train: DataFrame) -> Predict:
        models = {t: f(train) for t, f in learners.items()}

        def predict(rows: DataFrame) -> DataFrame:
            for t, m in models.items():
                rows = m(rows).select(*rows.columns, F.col("prediction").alias(f"{t}_predicted"))
            return rows

        return predict

    return fit


# -- stacking, tuning, selection of columns ---------------------------------------------------


def stacking(learners: dict[str, Learner], meta: Callable[[list[str]], Learner], fold: str, k: int) -> Learner:
    """A learner over the others' out-of-fold p: `meta` gets the names of the columns that hold them."""

    def add(models: dict[str, Predict], rows: DataFrame) -> DataFrame:
        for n, m in models.items():
            rows = m(rows).select(*rows.columns, F.col("p").alias(n))
        return rows

    def fit(train: DataFrame) -> Predict:
        outside = reduce(lambda a, b: a.unionByName(b), (add({n: f(train.where(F.col(fold) != i)) for n, f in learners.items()}, train.where(F.col(fold) == i)) for i in range(k)))
        top, models = meta(list(learners))(outside), {n: f(train) for n, f in learners.items()}
        return lambda rows: top(add(models, rows)).drop(*learners)

    return fit


def accuracies(df: DataFrame, learner: Learner, fold: str, k: int, actual: str) -> list[float]:
    """The share of right predictions in each fold."""
    found = cross_validate(df, fold, k, learner).groupBy(fold).agg(F.avg((F.col("prediction") == F.col(actual)).cast("double")).alias("ca")).collect()
    return [x for _, x in sorted((r[0], r[1]) for r in found)]


def tune(df: DataFrame, make: Callable[[object], Learner], options: Sequence[object], fold: str, k: int, actual: str) -> tuple[object, list[tuple[object, float]]]:
    """The first option of the highest mean accuracy, and all of them with theirs."""
    scores = [(o, sum(a := accuracies(df, make(o), fold, k, actual)) / len(a)) for o in options]
    return max(scores, key=lambda x: x[1])[0], scores


def tune_many(df: DataFrame, make: Callable[..., Learner], options: dict[str, Sequence[object]], fold: str, k: int, actual: str) -> tuple[dict, list[tuple[dict, float]]]:
    """As `tune`, over all combinations of several parameters."""
    every = [{}]
    for name, values in options.items():
        every = [{**o, name: v} for o in every for v in values]
    return tune(df, lambda o: make(**o), every, fold, k, actual)


def cutoffs(df: DataFrame, positive: str = "1") -> DataFrame:
    """(threshold, ca): accuracy of calling rows positive from each score on. df: (actual, p)."""
    t = df.groupBy("p").agg(F.count_if(F.col("actual") == positive).alias("pos"), F.count_if(F.col("actual") != positive).alias("neg"))
    whole = t.agg(F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    t = running(t, ["p"], {"below_pos": "pos", "below_neg": "neg"}).join(F.broadcast(whole))
    right = F.col("np") - (F.col("below_pos") - F.col("pos")) + F.col("below_neg") - F.col("neg")
    return t.select(F.col("p").alias("threshold"), (right / (F.col("np") + F.col("nn"))).alias("ca"))


def best_cutoff(df: DataFrame, positive: str = "1") -> DataFrame:
    """One row: the lowest threshold of the highest accuracy."""
    return cutoffs(df, positive).agg(F.min_by(F.struct("threshold", "ca"), F.struct(-F.col("ca"), F.col("threshold"))).alias("b")).select("b.*")


def signed_rank_p(a: Sequence[float], b: Sequence[float]) -> float:
    """Two-sided p of Wilcoxon's signed ranks, by the normal approximation; 1 where all pairs are equal."""
    d = [x - y for x, y in zip(a, b, strict=True) if x != y]
    if not d:
        return 1.0
    size = sorted(abs(x) for x in d)
    rank = {v: (2 * size.index(v) + size.count(v) + 1) / 2 for v in set(size)}
    n, w = len(d), min(sum(rank[abs(x)] for x in d if x > 0), sum(rank[abs(x)] for x in d if x < 0))
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def stepwise(df: DataFrame, names: Sequence[str], make: Callable[[list[str]], Learner], fold: str, k: int, actual: str, add: float = 0.2, remove: float = 0.3) -> list[str]:
    """Columns by turns of removal and addition: one goes if accuracy rises, or falls with p above `remove`; one comes if it rises with p below `add`."""
    if remove < add:
        raise ValueError("remove must not be below add, or a column could come and go for ever")
    chosen: list[str] = []
    now = accuracies(df, majority(actual), fold, k, actual)
    mean = lambda x: sum(x) / len(x)
    while True:
        moved = False
        if len(chosen) > 1:
            tries = [(c, accuracies(df, make([x for x in chosen if x != c]), fold, k, actual)) for c in chosen]
            fit = [(c, a) for c, a in tries if mean(a) > mean(now) or signed_rank_p(now, a) > remove]
            if fit:
                c, now = max(fit, key=lambda x: mean(x[1]))
                chosen, moved = [x for x in chosen if x != c], True
        tries = [(c, accuracies(df, make([*chosen, c]), fold, k, actual)) for c in names if c not in chosen]
        fit = [(c, a) for c, a in tries if mean(a) > mean(now) and signed_rank_p(now, a) < add]
        if fit:
            c, now = max(fit, key=lambda x: mean(x[1]))
            chosen, moved = [*chosen, c], True
        if not moved:
            return chosen


def eliminate(df: DataFrame, names: Sequence[str], score: Callable[[DataFrame, list[str]], dict[str, float]], keep: int) -> list[str]:
    """Recursive elimination: columns are scored together, and the lowest goes, until `keep` are left."""
    left = list(names)
    while len(left) > keep:
        found = score(df, left)
        left.remove(min(left, key=lambda c: (found[c], c)))
    return left


def linear_weights(df: DataFrame, names: Sequence[str], label: str, **options: object) -> dict[str, float]:
    """Squared weights of a linear support vector machine on standardized columns."""
    from pyspark.ml.classification import LinearSVC

    row = df.agg(*(F.stddev_pop(c).alias(c) for c in names)).first()
    model = LinearSVC(featuresCol="features", labelCol=label, **options).fit(learn.assembled(df, names))
    return {c: float((w * (row[c] or 0.0)) ** 2) for c, w in zip(names, model.coefficients, strict=True)}


def forest_weights(df: DataFrame, names: Sequence[str], label: str, **options: object) -> dict[str, float]:
    """Importances of columns in a random forest."""
    from pyspark.ml.classification import RandomForestClassifier

    model = RandomForestClassifier(featuresCol="features", labelCol=label, **options).fit(learn.assembled(df, names))
    return dict(zip(names, map(float, model.featureImportances.toArray()), strict=True))


def subsets(names: Sequence[str], least: int, most: int) -> list[tuple[str, ...]]:
    """Sets of columns of `least` to `most` members, smaller ones first."""
    return [s for k in range(least, most + 1) for s in combinations(names, k)]


# -- experiments ---------------------------------------------------------------------------------


def experiment(df: DataFrame, learners: dict[str, Learner], fold: str, k: int, key: str, actual: str) -> DataFrame:
    """(row, fold, learner, actual, predicted): every row predicted by every learner, trained on the other folds."""
    parts = [cross_validate(df, fold, k, f).select(F.col(key).alias("row"), F.col(fold).alias("fold"), F.lit(n).alias("learner"), F.col(actual).alias("actual"), F.col("prediction").alias("predicted")) for n, f in learners.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def leave_one_out(df: DataFrame, learners: dict[str, Learner], key: str, actual: str) -> DataFrame:
    """As `experiment`, each row a fold of its own."""
    n = df.limit(MOST_LEFT_OUT + 1).count()
    if n > MOST_LEFT_OUT:
        raise ValueError(f"more than {MOST_LEFT_OUT} rows to leave out")
    return experiment(numbered(df, [key], "_fold"), learners, "_fold", n, key, actual)


def proportion_test(df: DataFrame, learners: dict[str, Learner], key: str, actual: str, share: float = 0.7, times: int = 10, seed: int = 0) -> DataFrame:
    """(row, fold, learner, actual, predicted) of `times` splits: a share of rows trains, the rest is predicted; fold is the split."""
    out = []
    for i in range(times):
        split = subset_two(df, share, [key], seed + i, out="_part")
        for n, f in learners.items():
            found = f(split.where("_part = 0"))(split.where("_part = 1"))
            out.append(found.select(F.col(key).alias("row"), F.lit(i).alias("fold"), F.lit(n).alias("learner"), F.col(actual).alias("actual"), F.col("prediction").alias("predicted")))
    return reduce(lambda a, b: a.unionByName(b), out)


def with_predictions(df: DataFrame, models: dict[str, Predict]) -> DataFrame:
    """The table with a column of predictions per model."""
    for n, m in models.items():
        df = m(df).select(*df.columns, F.col("prediction").alias(n))
    return df


def scored(experiments: DataFrame, measure: Callable[[], Column] | None = None) -> DataFrame:
    """(learner, ca): the share of right predictions, or another aggregate, of each learner."""
    right = F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("ca")
    return experiments.groupBy("learner").agg(measure() if measure else right)
