"""Scores and curves of several classes, folds and thresholds, over the long table of predictions that `evaluate` describes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.evaluate import multilabel
from tarnwork.operators.relational import running


def auc_by_class(df: DataFrame) -> DataFrame:
    """(class, n, auc): each class against all others; df: (actual, class, p), a row for each class. A class that all rows or none have has no AUC."""
    t = df.groupBy("class", "p").agg(F.count_if(F.col("actual") == F.col("class")).cast("double").alias("pos"), F.count_if(F.col("actual") != F.col("class")).cast("double").alias("neg"))
    t = running(t, ["p"], {"upto": "neg"}, ["class"]).withColumn("u", F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    return t.groupBy("class").agg(F.sum("pos").cast("long").alias("n"), F.try_divide(F.sum("u"), F.sum("pos") * F.sum("neg")).alias("auc"))


def auc_one_vs_all(df: DataFrame, weighted: bool = True) -> DataFrame:
    """The mean of the classes' AUCs, weighted by how many rows have the class."""
    known = F.when(F.col("auc").isNotNull(), F.col("n") if weighted else F.lit(1.0))
    return auc_by_class(df).agg(F.try_divide(F.sum(known * F.col("auc")), F.sum(known)).alias("auc"))


def counts(df: DataFrame, positive: str = "1", groups: Sequence[str] = ()) -> DataFrame:
    """(groups, threshold, neg, pos, nn, np): negative and positive rows that score at least the threshold, of all; a null threshold, at which none do, begins each curve."""
    t = df.groupBy(*groups, "p").agg(F.count_if(F.col("actual") == positive).alias("a"), F.count_if(F.col("actual") != positive).alias("b"))
    whole = t.groupBy(*groups).agg(F.sum("b").alias("nn"), F.sum("a").alias("np"))
    curve = running(t, [F.col("p").desc()], {"neg": "b", "pos": "a"}, groups).select(*groups, F.col("p").alias("threshold"), "neg", "pos")
    begin = whole.select(*groups, F.lit(None).cast(df.schema["p"].dataType).alias("threshold"), F.lit(0).cast("long").alias("neg"), F.lit(0).cast("long").alias("pos"))
    curve = curve.unionByName(begin)
    return curve.join(whole, list(groups)) if groups else curve.join(F.broadcast(whole))


def _rates() -> list[Column]:
    return [F.try_divide("neg", "nn").alias("fpr"), F.try_divide("pos", "np").alias("tpr")]


def _corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The upper convex hull of a partition's points, in whole numbers."""
    rows = pd.concat(list(batches) or [pd.DataFrame(columns=["neg", "pos"])])
    rows = rows.sort_values(["neg", "pos"], kind="stable")
    hull: list[int] = []
    x, y = [int(v) for v in rows["neg"]], [int(v) for v in rows["pos"]]
    for k in range(len(x)):
        while len(hull) > 1:
            i, j = hull[-2:]
            if (x[k] - x[i]) * (y[j] - y[i]) > (y[k] - y[i]) * (x[j] - x[i]):
                break
            hull.pop()
        hull.append(k)
    if hull:
        yield rows.iloc[hull]


def roc_hull(df: DataFrame, positive: str = "1") -> DataFrame:
    """(threshold, fpr, tpr) at the corners of the ROC curve's convex hull, (0, 0) and (1, 1) among them.

    Each range of thresholds gives its own corners, and the corners of these are the curve's. Corners are points of whole numbers on a convex curve, so that n rows have at
    most about n^(2/3) of them, which one task can hold.
    """
    t = counts(df, positive)
    shape = t.schema
    parts = t.repartitionByRange(F.col("neg"), F.col("pos")).mapInPandas(_corners, shape)
    return parts.repartition(1).mapInPandas(_corners, shape).select("threshold", *_rates())


def vertical_average(df: DataFrame, samples: int = 10, positive: str = "1") -> DataFrame:
    """(fpr, tpr, deviation): the folds' curves averaged at evenly spread false positive rates, each curve taken straight between its points; deviation is 0 of one fold. Folds without a positive or a negative row are left out."""
    points = counts(df, positive, ["fold"]).select("fold", *_rates()).where("fpr is not null and tpr is not null")
    at, here = [k / samples for k in range(samples + 1)], F.struct("fpr", "tpr")
    ends = points.groupBy("fold").agg(*(f(F.when(cond, here)).alias(f"{p}{k}") for k, x in enumerate(at) for p, f, cond in (("a", F.max, F.col("fpr") <= x), ("b", F.min, F.col("fpr") > x))))

    def between(k: int, x: float) -> Column:
        a, b = (lambda c: F.col(f"a{k}.{c}")), (lambda c: F.col(f"b{k}.{c}"))
        return F.when(F.col(f"b{k}").isNull() | (a("fpr") == x), a("tpr")).otherwise(a("tpr") + (b("tpr") - a("tpr")) / (b("fpr") - a("fpr")) * (x - a("fpr")))

    long = ends.select(F.explode(F.array(*(F.struct(F.lit(x).alias("fpr"), between(k, x).alias("tpr")) for k, x in enumerate(at)))).alias("r")).select("r.*")
    return long.groupBy("fpr").agg(F.avg("tpr").alias("tpr"), F.coalesce(F.stddev_samp("tpr"), F.lit(0.0)).alias("deviation"))


def threshold_average(df: DataFrame, thresholds: Sequence[float], positive: str = "1") -> DataFrame:
    """(threshold, fpr, tpr, fpr_deviation, tpr_deviation): the folds' points at given thresholds, averaged."""
    p = F.col("actual") == positive
    per = df.groupBy("fold").agg(F.count_if(~p).alias("nn"), F.count_if(p).alias("np"), *(F.count_if((F.col("p") >= x) & c).alias(f"{n}{k}") for k, x in enumerate(thresholds) for n, c in (("neg", ~p), ("pos", p))))
    long = per.select("nn", "np", F.explode(F.array(*(F.struct(F.lit(float(x)).alias("threshold"), F.col(f"neg{k}").alias("neg"), F.col(f"pos{k}").alias("pos")) for k, x in enumerate(thresholds)))).alias("r"))
    long = long.where("nn > 0 and np > 0").select("r.threshold", F.try_divide("r.neg", "nn").alias("fpr"), F.try_divide("r.pos", "np").alias("tpr"))
    return long.groupBy("threshold").agg(F.avg("fpr").alias("fpr"), F.avg("tpr").alias("tpr"), *(F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_deviation") for c in ("fpr", "tpr")))


def best_thresholds(df: DataFrame, fp_cost: float, fn_cost: float, prior: float, positive: str = "1") -> DataFrame:
    """(threshold, fpr, tpr) of the points that cost least when a share `prior` of rows is positive: the highest above lines of slope fp_cost (1 - prior) / (fn_cost prior), all that are within 0.0001 of it."""
    m = fp_cost * (1 - prior) / (fn_cost * prior)
    curve = counts(df, positive).select("threshold", *_rates()).withColumn("_d", F.abs(F.col("tpr") - m * F.col("fpr") - 1) / (1 + m * m) ** 0.5)
    return curve.join(F.broadcast(curve.agg(F.min("_d").alias("_least")))).where("_d - _least <= 0.0001").select("threshold", "fpr", "tpr")


def log_loss(df: DataFrame, positive: str = "1") -> DataFrame:
    """Mean of -ln of the probability that the actual class was given, of n rows none above ln n."""
    own = F.when(F.col("actual") == positive, F.col("p")).otherwise(1 - F.col("p"))
    n = df.agg(F.count("*").alias("_n"))
    return df.join(F.broadcast(n)).agg(F.avg(-F.greatest(F.ln(F.greatest(own, F.lit(1e-20))), -F.ln("_n"))).alias("log_loss"))


def f1_of_labels(df: DataFrame, actual: Sequence[str], predicted: Sequence[str]) -> DataFrame:
    """(f1_micro, f1_macro) of label sets (0/1 columns): of mean precision and recall; and the mean of the labels' own, whose counts each begin at 1e-7."""
    p, r = F.col("precision"), F.col("recall")
    micro = multilabel(df, actual, predicted).select(F.when((p == 0) & (r == 0), 0.0).otherwise(2 * p * r / (p + r)).alias("f1_micro"))
    begin = F.lit(1e-7)
    each = [(F.count_if((F.col(a) == 1) & (F.col(b) == 1)) + begin, F.count_if(F.col(b) == 1) + begin, F.count_if(F.col(a) == 1) + begin) for a, b in zip(actual, predicted, strict=True)]
    f1 = [2 * (tp / said * tp / true) / (tp / said + tp / true) for tp, said, true in each]
    return micro.join(F.broadcast(df.agg((reduce(lambda a, b: a + b, f1) / len(f1)).alias("f1_macro"))))
