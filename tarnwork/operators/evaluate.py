"""Evaluation over a long table of predictions: (row, fold, actual, predicted, p), p the probability of a positive, or of the actual class."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.operators.relational import running


def regression(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MSE, RMSE, MAE, RSE, RRSE, RAE and R2; relative errors compare with the mean of the actual values."""
    y, p = F.col(actual), F.col(predicted)
    mean = df.agg(F.avg(y).alias("_m"))
    d = df.join(F.broadcast(mean))
    sse, sae = F.sum((y - p) * (y - p)), F.sum(F.abs(y - p))
    sst, sat = F.sum((y - F.col("_m")) * (y - F.col("_m"))), F.sum(F.abs(y - F.col("_m")))
    n = F.count("*")
    return d.agg((sse / n).alias("mse"), F.sqrt(sse / n).alias("rmse"), (sae / n).alias("mae"), (sse / sst).alias("rse"), F.sqrt(sse / sst).alias("rrse"), (sae / sat).alias("rae"), (1 - sse / sst).alias("r2"))


def classification(df: DataFrame, positive: str = "1") -> DataFrame:
    """CA, AP (mean probability of the actual class), Brier score and information score of binary predictions with p of the positive class."""
    hit = (F.col("actual") == F.col("predicted")).cast("double")
    own = F.when(F.col("actual") == positive, F.col("p")).otherwise(1 - F.col("p"))
    share = df.agg(F.avg((F.col("actual") == positive).cast("double")).alias("_s"))
    prior = F.when(F.col("actual") == positive, F.col("_s")).otherwise(1 - F.col("_s"))
    brier = 1 + F.col("p") * F.col("p") + (1 - F.col("p")) * (1 - F.col("p")) - 2 * own
    info = F.when(own >= prior, -F.log2(prior) + F.log2(own)).otherwise(F.log2(1 - prior) - F.log2(1 - own))
    return df.join(F.broadcast(share)).agg(F.avg(hit).alias("ca"), F.avg(own).alias("ap"), F.avg(brier).alias("brier"), (1 - F.avg(brier) / 2).alias("bss"), F.avg(info).alias("information_score"))


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def cells(df: DataFrame, positive: str = "1") -> DataFrame:
    a, p = F.col("actual") == positive, F.col("predicted") == positive
    return df.agg(*(F.count_if(x & y).cast("double").alias(n) for n, x, y in (("tp", a, p), ("fn", a, ~p), ("fp", ~a, p), ("tn", ~a, ~p))))


def binary_measures(df: DataFrame, positive: str = "1", alpha: float = 2.0) -> DataFrame:
    """Sensitivity, specificity, PPV, NPV, F1, F-alpha, MCC, Scott's pi; unknown where a denominator is 0."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    d = lambda a, b: F.try_divide(a, b)
    precision, recall, n = d(tp, tp + fp), d(tp, tp + fn), tp + fn + fp + tn
    chance = F.pow((tp + fn + tp + fp) / (2 * n), F.lit(2.0)) + F.pow((tn + fp + tn + fn) / (2 * n), F.lit(2.0))
    return cells(df, positive).select(
        recall.alias("sensitivity"), d(tn, tn + fp).alias("specificity"), precision.alias("ppv"), d(tn, tn + fn).alias("npv"), d(2 * precision * recall, precision + recall).alias("f1"),
        d((1 + alpha) * precision * recall, alpha * precision + recall).alias("falpha"),
        d(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"), d((tp + tn) / n - chance, 1 - chance).alias("scotts_pi"),
    )


def auc(df: DataFrame, positive: str = "1", by_fold: bool = True) -> DataFrame:
    """Concordance with half credit for ties, averaged over folds; folds merge if one has a single class. Running totals go over distinct scores."""
    fold = F.col("fold") if by_fold else F.lit(0)
    t = df.groupBy(fold.alias("fold"), "p").agg(F.count_if(F.col("actual") == positive).cast("double").alias("pos"), F.count_if(F.col("actual") != positive).cast("double").alias("neg"))
    t = running(t, ["p"], {"upto": "neg"}, ["fold"]).withColumn("u", F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    per = t.groupBy("fold").agg(F.sum("u").alias("u"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    if by_fold and per.where("np = 0 or nn = 0").limit(1).count():
        return auc(df, positive, by_fold=False)
    return per.agg(F.avg(F.try_divide(F.col("u"), F.col("np") * F.col("nn"))).alias("auc"))


def auc_wilcoxon(df: DataFrame, positive: str = "1") -> DataFrame:
    """AUC over all rows with its standard error."""
    sizes = df.agg(F.count_if(F.col("actual") == positive).cast("double").alias("np"), F.count_if(F.col("actual") != positive).cast("double").alias("nn"))
    a, p, n = F.col("auc"), F.col("np"), F.col("nn")
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    return auc(df, positive, by_fold=False).join(F.broadcast(sizes)).select("auc", F.sqrt((a * (1 - a) + (p - 1) * (q1 - a * a) + (n - 1) * (q2 - a * a)) / (p * n)).alias("se"))


def concordance(df: DataFrame, positive: str = "1") -> DataFrame:
    """(c, d, t): pairs of a positive and a negative row whose scores agree, disagree, and tie."""
    t = df.groupBy("p").agg(F.count_if(F.col("actual") == positive).cast("double").alias("pos"), F.count_if(F.col("actual") != positive).cast("double").alias("neg"))
    whole = t.agg(F.sum("neg").alias("nn"))
    t = running(t, ["p"], {"upto": "neg"}).join(F.broadcast(whole))
    return t.agg(F.sum(F.col("pos") * (F.col("upto") - F.col("neg"))).alias("c"), F.sum(F.col("pos") * (F.col("nn") - F.col("upto"))).alias("d"), F.sum(F.col("pos") * F.col("neg")).alias("t"))


def compare_aucs(df: DataFrame, first: str, second: str, positive: str = "1") -> DataFrame:
    """(first, second, difference, se, z) of two scores of the same rows, each AUC with its own standard error."""
    a, b = (auc_wilcoxon(df.select("actual", F.col(c).alias("p")), positive).select(F.col("auc").alias(f"a{k}"), F.col("se").alias(f"s{k}")) for k, c in enumerate((first, second)))
    se = F.sqrt(F.col("s0") * F.col("s0") + F.col("s1") * F.col("s1"))
    d = F.col("a0") - F.col("a1")
    return a.join(F.broadcast(b)).select(F.col("a0").alias("first"), F.col("a1").alias("second"), d.alias("difference"), se.alias("se"), F.try_divide(d, se).alias("z"))


def auc_pairs(df: DataFrame, weighted: bool = True) -> DataFrame:
    """Multiclass AUC over pairs of classes; df: (actual, class, p), a row per class. Weighted by the product of both classes' shares."""
    share = df.select("row", "actual").distinct().groupBy("actual").agg(F.count("*").cast("double").alias("n"))
    a = df.join(share.select(F.col("actual").alias("c1"), F.col("n").alias("n1")), F.col("class") == F.col("c1"))
    pairs = a.join(share.select(F.col("actual").alias("c2"), F.col("n").alias("n2")), F.col("c1") != F.col("c2")).where((F.col("actual") == F.col("c1")) | (F.col("actual") == F.col("c2")))  # classes are few
    t = pairs.groupBy("c1", "c2", "n1", "n2", "p").agg(F.count_if(F.col("actual") == F.col("c1")).cast("double").alias("pos"), F.count_if(F.col("actual") == F.col("c2")).cast("double").alias("neg"))
    t = running(t, ["p"], {"upto": "neg"}, ["c1", "c2"]).withColumn("u", F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    u = t.groupBy("c1", "c2", "n1", "n2").agg((F.sum("u") / (F.col("n1") * F.col("n2"))).alias("a"))
    w = F.col("n1") * F.col("n2") if weighted else F.lit(1.0)
    return u.agg((F.sum(w * F.col("a")) / F.sum(w)).alias("auc"))


def roc(df: DataFrame, positive: str = "1") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score."""
    t = df.groupBy("p").agg(F.count_if(F.col("actual") == positive).alias("pos"), F.count_if(F.col("actual") != positive).alias("neg"))
    t, whole = running(t, [F.col("p").desc()], {"negs": "neg", "poss": "pos"}), t.agg(F.sum("neg").alias("nn"), F.sum("pos").alias("np"))
    return t.join(F.broadcast(whole)).select(F.col("p").alias("threshold"), F.try_divide("negs", "nn").alias("fpr"), F.try_divide("poss", "np").alias("tpr"))


def lift_curve(df: DataFrame, positive: str = "1") -> DataFrame:
    """(share of rows taken, share of positives found), best scores first."""
    t = df.groupBy("p").agg(F.count_if(F.col("actual") == positive).alias("pos"), F.count("*").alias("n"))
    t, whole = running(t, [F.col("p").desc()], {"ns": "n", "poss": "pos"}), t.agg(F.sum("n").alias("all"), F.sum("pos").alias("np"))
    return t.join(F.broadcast(whole)).select(F.try_divide("ns", "all").alias("taken"), F.try_divide("poss", "np").alias("found"))


def calibration(df: DataFrame, bins: int = 10, positive: str = "1") -> DataFrame:
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.avg("p").alias("predicted"), F.avg((F.col("actual") == positive).cast("double")).alias("observed"), F.count("*").alias("n"))


def mcnemar(df: DataFrame, first: str, second: str) -> DataFrame:
    """(|b - c| - 1)^2 / (b + c) of two learners' mistakes on the same rows."""
    f, s = F.col(first) == F.col("actual"), F.col(second) == F.col("actual")
    t = df.agg(F.count_if(f & ~s).cast("double").alias("b"), F.count_if(~f & s).cast("double").alias("c"))
    b, c = F.col("b"), F.col("c")
    return t.select("b", "c", F.when(b + c > 0, (F.abs(b - c) - 1) * (F.abs(b - c) - 1) / (b + c)).otherwise(0.0).alias("mcnemar"))


def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """Friedman's chi-square over mean ranks of treatments within blocks (ties share ranks)."""
    by = Window.partitionBy(block)
    rank = F.rank().over(by.orderBy(value)) + (F.count("*").over(Window.partitionBy(block, value)) - 1) / 2
    ranks = df.select(block, treatment, rank.alias("r"))
    mean = ranks.groupBy(treatment).agg(F.avg("r").alias("m"), F.count("*").cast("double").alias("n"))
    k = F.count("*")
    return mean.agg((12 * F.max("n") / (k * (k + 1)) * (F.sum(F.col("m") * F.col("m")) - k * (k + 1) * (k + 1) / 4)).alias("friedman"))


def nemenyi_cd(k: int, n: int, alpha: str = "0.05") -> float:
    """Critical difference of mean ranks of k learners over n data sets."""
    # Studentized range statistic over sqrt(2), for 2 to 10 learners.
    q = {"0.05": [1.959964, 2.343701, 2.569032, 2.727774, 2.849705, 2.948320, 3.030879, 3.101730, 3.163684], "0.1": [1.644854, 2.052293, 2.291341, 2.459516, 2.588521, 2.692732, 2.779884, 2.854606, 2.919889]}
    return q[alpha][k - 2] * math.sqrt(k * (k + 1) / (6 * n))


def multilabel(df: DataFrame, actual: Sequence[str], predicted: Sequence[str]) -> DataFrame:
    """Hamming loss, accuracy, precision and recall of label sets (0/1 columns); empty denominators count as 0."""
    pairs = list(zip(actual, predicted, strict=True))
    total = lambda f: sum((f(F.col(a), F.col(p)) for a, p in pairs[1:]), f(F.col(pairs[0][0]), F.col(pairs[0][1])))
    both, either = total(lambda a, p: (a * p).cast("double")), total(lambda a, p: F.greatest(a, p).cast("double"))
    wrong, na, np_ = total(lambda a, p: F.abs(a - p).cast("double")), total(lambda a, p: a.cast("double")), total(lambda a, p: p.cast("double"))
    share = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return df.agg(F.avg(wrong / len(pairs)).alias("hamming_loss"), F.avg(share(both, either)).alias("accuracy"), F.avg(share(both, np_)).alias("precision"), F.avg(share(both, na)).alias("recall"))


def cross_validate(df: DataFrame, fold: str, k: int, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each fold predicted by what the others teach: fit(train) returns a function from rows to rows with predictions."""
    from functools import reduce

    parts = [fit(df.where(F.col(fold) != i))(df.where(F.col(fold) == i)) for i in range(k)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def learning_curve(df: DataFrame, order: Sequence[str], shares: Sequence[float], test: DataFrame, fit: Callable, score: Callable[[DataFrame], Column | float], seed: int = 0) -> list[tuple[float, float]]:
    from tarnwork.operators.sampling import sample

    return [(s, score(fit(sample(df, order, share=s, seed=seed))(test))) for s in shares]
