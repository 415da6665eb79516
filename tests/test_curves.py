"""Curves and scores of several classes, folds and labels, and tests' probabilities, against NumPy and known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.functions import stats as C
from tarnwork.operators import curves as K

SCHEMA = "row int, fold int, actual string, p double"


def rows(n=400, seed=2, digits=3):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.4
    return [(i, i % 4, str(int(v)), float(np.round(np.clip(0.3 * v + rng.random() * 0.7, 0, 1), digits))) for i, v in enumerate(y)]


def curve(data):
    at = sorted({r[3] for r in data}, reverse=True)
    y = np.array([r[2] == "1" for r in data])
    p = np.array([r[3] for r in data])
    return [(0, 0)] + [(int((~y & (p >= t)).sum()), int((y & (p >= t)).sum())) for t in at]


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_hull(spark, digits):
    data = rows(digits=digits)
    points = sorted(curve(data))
    hull = []
    for x, y in points:
        while len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (x - hull[-2][0]) <= (y - hull[-2][1]) * (hull[-1][0] - hull[-2][0]):
            hull.pop()
        hull.append((x, y))
    nn, pp = points[-1]
    got = sorted((round(r.fpr * nn), round(r.tpr * pp)) for r in K.roc_hull(spark.createDataFrame(data, SCHEMA).repartition(5)).collect())
    assert got == hull
    for x, y in points:  # nothing lies above
        assert y <= np.interp(x, *zip(*[(a, b) for a, b in hull], strict=True)) + 1e-9 or any(a == x and b >= y for a, b in hull)


def test_averages(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    want = []
    for k in range(11):
        x, each = k / 10, []
        for f in range(4):
            c = np.array(curve([r for r in data if r[1] == f]), float)
            c /= c[-1]
            i = int(np.nonzero(c[:, 0] <= x)[0][-1])
            each.append(c[i, 1] if c[i, 0] == x or i + 1 == len(c) else c[i, 1] + (c[i + 1, 1] - c[i, 1]) / (c[i + 1, 0] - c[i, 0]) * (x - c[i, 0]))
        want.append((x, np.mean(each), np.std(each, ddof=1)))
    got = sorted(map(tuple, K.vertical_average(df).collect()))
    assert np.allclose(got, want)
    one = K.vertical_average(df.where("fold = 0"), 4).collect()
    assert len(one) == 5 and {r.deviation for r in one} == {0.0}
    at = {r.threshold: r for r in K.threshold_average(df, [0.25, 0.5]).collect()}
    shares = [np.mean([r[3] >= 0.5 for r in data if r[1] == f and r[2] == "1"]) for f in range(4)]
    assert math.isclose(at[0.5].tpr, np.mean(shares)) and math.isclose(at[0.5].tpr_deviation, np.std(shares, ddof=1))


def test_best_threshold_costs_least(spark):
    data = rows()
    c = np.array(curve(data), float)
    c /= c[-1]
    for fp, fn, prior in ((1, 1, 0.5), (5, 1, 0.3), (1, 9, 0.2)):
        cost = lambda x, y: fp * (1 - prior) * x + fn * prior * (1 - y)  # noqa: B023, E731
        least = min(cost(*p) for p in c)
        got = K.best_thresholds(spark.createDataFrame(data, SCHEMA), fp, fn, prior).collect()
        assert got and all(cost(r.fpr, r.tpr) <= least + 1e-3 for r in got) and any(abs(cost(r.fpr, r.tpr) - least) < 1e-12 for r in got)


def test_one_vs_all(spark):
    rng = np.random.default_rng(3)
    data = [(i, "abc"[k], "abc"[c], float(np.round(rng.random() + 0.4 * (k == c), 2))) for i, k in enumerate(rng.integers(0, 3, 90)) for c in range(3)]
    df = spark.createDataFrame(data, "row int, actual string, class string, p double")

    def auc(c):
        pos, neg = ([p for _, a, k, p in data if k == c and (a == c) is own] for own in (True, False))
        return np.mean([(x > y) + (x == y) / 2 for x in pos for y in neg]), len(pos)

    want = {c: auc(c) for c in "abc"}
    got = {r["class"]: r for r in K.auc_by_class(df).collect()}
    assert all(math.isclose(got[c].auc, want[c][0]) and got[c].n == want[c][1] for c in "abc")
    assert math.isclose(K.auc_one_vs_all(df).first().auc, sum(a * n for a, n in want.values()) / 90)
    assert math.isclose(K.auc_one_vs_all(df, weighted=False).first().auc, np.mean([a for a, _ in want.values()]))
    none = df.where("actual = 'a'")  # of one class only: no class has an AUC
    assert K.auc_one_vs_all(none).first().auc is None


def test_losses(spark):
    df = spark.createDataFrame([(0, 0, "1", 0.8), (1, 0, "0", 0.5), (2, 0, "1", 0.0), (3, 0, "0", 1.0)], SCHEMA)
    assert math.isclose(K.log_loss(df).first().log_loss, (-math.log(0.8) - math.log(0.5) + 2 * math.log(4)) / 4)
    t = spark.createDataFrame([(1, 0, 1, 0), (1, 1, 0, 1), (0, 0, 1, 0)], "a int, b int, c int, d int")
    r = K.f1_of_labels(t, ["a", "b"], ["c", "d"]).first()
    assert math.isclose(r.f1_micro, 2 * (2 / 3) * 0.5 / (2 / 3 + 0.5)) and math.isclose(r.f1_macro, (0.5 + 1) / 2, rel_tol=1e-6)


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert K.vertical_average(none).count() == K.threshold_average(none, [0.5]).count() == 0
    assert K.log_loss(none).first().log_loss is None
    assert all(r.fpr is None for r in K.roc_hull(none).collect())
    positive = spark.createDataFrame([(0, 0, "1", 0.5)], SCHEMA)
    assert K.vertical_average(positive).count() == 0


def test_tests(spark):
    t = spark.createDataFrame([("x", "u")] * 10 + [("x", "v")] * 20 + [("y", "u")] * 30 + [("y", "w")] * 5 + [(None, "u")] * 9, "a string, b string")
    o = np.array([[10, 20, 0], [30, 0, 5]], float)
    e = o.sum(1)[:, None] * o.sum(0) / o.sum()
    r = C.chisquare2d(t, "a", "b").first()
    chi2 = ((o - e) ** 2 / e).sum()
    assert math.isclose(r.chi2, chi2) and r.df == 2 and math.isclose(r.p, math.exp(-chi2 / 2), rel_tol=1e-6) and math.isclose(r.cramers_v, math.sqrt(chi2 / 65)) and math.isclose(r.contingency, math.sqrt(chi2 / (chi2 + 65)))
    one = C.chisquare2d(t.where("a = 'x'"), "a", "b").first()
    assert one.df == 0 and one.p is None
    x = np.array([[5.0, 7, 9], [4, 6, 5], [8, 8, 12], [3, 9, 7]])
    long = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(4) for j in range(3)], "s int, t int, x double")
    between = 4 * ((x.mean(0) - x.mean()) ** 2).sum() / 2
    error = ((x - x.mean(0) - x.mean(1)[:, None] + x.mean()) ** 2).sum() / 6
    r = C.anova_rel(long, "s", "t", "x").first()
    f = between / error
    assert math.isclose(r.f, f) and (r.df_between, r.df_error) == (2, 6) and math.isclose(r.p, (1 + 2 * f / 6) ** -3, rel_tol=1e-6)
    with pytest.raises(Exception, match="lack treatments"):
        C.anova_rel(long.where("s > 0 or t > 0"), "s", "t", "x").collect()
    with pytest.raises(Exception, match="lack treatments"):
        C.anova_rel(long.union(long), "s", "t", "x").collect()
    ranks = spark.createDataFrame([(float(v), v % 3 == 0) for v in range(1, 13)], "v double, g boolean")
    z = (sum(v for v in range(1, 13) if v % 3 == 0) - 4 * 13 / 2) / math.sqrt(4 * 8 * 13 / 12)
    r = C.ranksums(ranks, "v", F.col("g")).first()
    assert math.isclose(r.z, z) and math.isclose(r.p, math.erfc(abs(z) / math.sqrt(2)))
    t = C.with_p(C.ttest_1samp(ranks, "v", 5.0), "t", "t", "df").first()
    assert 0.1 < t.p < 0.2 and math.isclose(t.p, C.tprob(t.t, 11))
