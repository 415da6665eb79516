"""Unknown values, ties, constants and empty tables; arithmetic known from textbooks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.functions import stats as C
from tarnwork.operators import aggregate as A
from tarnwork.operators import associate as N
from tarnwork.operators import distance as D
from tarnwork.operators import evaluate as E
from tarnwork.operators import filters as P
from tarnwork.operators import graph as G
from tarnwork.operators import learn as L
from tarnwork.operators import relational as R
from tarnwork.operators import sampling as S
from tarnwork.operators import scoring as M
from tarnwork.operators import transform as X


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame([(1, 1.0, "a", "y"), (2, None, "b", "n"), (3, 3.0, None, "y"), (4, 3.0, "a", None), (5, 7.0, "b", "n")], "k long, x double, d string, y string")


def test_tristate(spark, t):
    none = P.continuous("x", ">", 2, special=-1)
    assert P.accepts(t, P.conjunction(none, P.discrete("d", ["b"], special=-1))).count() == 3  # rows 2, 3 and 5
    assert P.accepts(t, P.disjunction(none)).count() == 3
    assert P.accepts(t, P.conjunction()).count() == 5 and P.accepts(t, P.disjunction()).count() == 0
    assert P.accepts(t, P.compatible({"x": 3.0, "d": "a"})).count() == 2
    assert P.accepts(t, P.same_example({"x": 3.0, "d": None})).count() == 1
    assert P.accepts(t.limit(0), none).count() == 0


def test_numbering_is_consecutive(spark):
    df = spark.range(1000).repartition(7)
    got = [r._no for r in R.numbered(df, ["id"]).orderBy("id").collect()]
    assert got == list(range(1000))


def test_hstack_checks(spark, t):
    other = t.select("k", F.col("x").alias("z"), F.lit("a").alias("d"))
    with pytest.raises(Exception, match="differs"):
        R.hstack(t, other, ["k"], ["k"]).collect()
    with pytest.raises(Exception, match="lengths differ"):
        R.hstack(t, t.select("k", F.col("x").alias("z")).where("k < 3"), ["k"], ["k"]).collect()


def test_joins_and_unknown_keys(spark):
    a = spark.createDataFrame([(1, "p"), (None, "q"), (2, "r")], "k long, a string")
    b = spark.createDataFrame([(1, "u", 1), (1, "v", 0), (None, "w", 2)], "j long, b string, o long")
    assert sorted((r.a, r.b) for r in R.equi_join(a, b, ["k"], ["j"]).collect() if r.b) == [("p", "u"), ("p", "v")]
    assert {r.a: r.b for r in R.lookup_join(a, b, ["k"], ["j"], ["o"]).collect()} == {"p": "v", "q": None, "r": None}
    assert {r.a: r.b for r in R.lookup_join(a, b, ["k"], ["j"], ["o"], True).collect()} == {"p": "v", "q": "w", "r": None}


def test_percentile_ties_and_weights(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0), (4.0, 1.0)], "x double, w double")
    assert tuple(A.percentiles(df, "x", [0, 25, 50, 60, 100]).first()) == (1.0, 1.5, 2.5, 3.0, 4.0)
    assert A.percentiles(df, "x", [50], weight=F.when(F.col("x") == 4, 9.0).otherwise(1.0)).first()[0] == 4.0
    assert A.percentiles(df.limit(0), "x", [50]).count() == 0


def test_statistics_of_nothing(spark, t):
    row = A.basic_statistics(t.withColumn("none", F.lit(None).cast("double")), ["none"]).first()
    assert (row.n, row.avg, row.dev) == (0.0, -1.0, -1.0)
    assert A.kaplan_meier(t.limit(0), "x", F.col("y") == "y").count() == 0


def test_survival(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0), (4, 1)], "t long, e long")
    got = {r.time: round(r.survival, 6) for r in A.kaplan_meier(df, "t", F.col("e") == 1).collect()}
    assert got == {1: 0.8, 3: round(0.8 * 2 / 3, 6), 4: 0.0}


def test_discretization(spark):
    weights = {"even": [1, 1, 1, 1], "tie": [1, 2, 1], "last": [1, 1, 1, 5], "few": [5, 1], "run": [1, 3, 3, 3, 1, 1]}
    counts = spark.createDataFrame([(c, float(x), float(w)) for c, ws in weights.items() for x, w in enumerate(ws)], "attribute string, x double, w double")
    assert X.frequency_cuts(counts, 2) == {"even": [1.5], "tie": [0.5], "last": [2.5], "few": [0.5], "run": [2.5]}
    assert X.frequency_cuts(counts.where("attribute = 'few'"), 4) == {"few": [0.5]} and X.frequency_cuts(counts.limit(0), 3) == {}
    assert X._mdl_cuts([(float(i), {"a": 5.0} if i < 5 else {"b": 5.0}) for i in range(10)]) == [4.0]
    assert X._mdl_cuts([(float(i), {"a": 1.0, "b": 1.0}) for i in range(10)]) == []
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (None,)], "x double")
    assert [r[0] for r in df.select(X.by_cuts(F.col("x"), [2.0])).collect()] == [0, 0, 1, None]
    assert X.interval_labels([1, 2]) == ["<=1", "(1, 2]", ">2"]
    assert [r[0] for r in df.select(X.equal_width(F.col("x"), 1.0, 0.0, 3)).collect()] == [0, 0, 0, None]


def test_imputation_and_normalization(spark, t):
    got = X.impute(t, ["x"], ["d"]).orderBy("k").collect()
    assert got[1].x == 3.0 and got[2].d == "a"
    const = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    assert [r[0] for r in X.normalize(const, ["x"]).collect()] == [0.0, 0.0, 0.0]


def test_scores_of_lenses_like_table(spark):
    rows = [(a, "y" if a == "p" else "n", "c") for a in "ppppqqqq"]
    s = {r.attribute: r for r in M.score_all(spark.createDataFrame(rows, "a string, y string, c string"), ["a", "c"], "y").collect()}
    assert s["a"].info_gain == pytest.approx(1.0) and s["a"].gini == pytest.approx(0.25) and s["c"].info_gain == 0.0 and s["c"].gain_ratio == 0.0
    half = spark.createDataFrame([*rows, *[(None, "y", "c")] * 8], "a string, y string, c string")
    assert {r.attribute: r.info_gain for r in M.score_all(half, ["a"], "y").collect()}["a"] == pytest.approx(0.5)


def test_sampling_is_exact(spark):
    df = spark.range(101).select("id", (F.col("id") % 2).alias("c"))
    assert S.subset_two(df, 0.5, ["id"], 1).where("subset = 0").count() == 51
    sizes = sorted(r["count"] for r in S.folds(df, 4, ["id"], 1, "c").groupBy("fold").count().collect())
    assert sizes == [25, 25, 25, 26]
    assert S.with_replacement(df, 50, ["id"], 1).count() == 50


def test_distances(spark):
    assert D.dtw([1, 2, 3], [1, 2, 3]) == 0 and D.dtw([0], [3]) == 3.0
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 1.0])], "k long, v array<double>")
    assert [(r.neighbour, r.d) for r in D.nearest_vectors(v.where("k = 1"), v, "k", "v", 2).orderBy("rank").collect()] == [(3, 1.0), (2, 5.0)]
    near = D.nearest(v.where("k = 1"), v, "k", D.array_distance(F.col("p.v"), F.col("t.v")), 1).first()
    assert (near.neighbour, near.d) == (3, 1.0)


def test_rules(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "a"), (3, "a"), (4, "c")], "key long, item string")
    sets = {tuple(r.itemset): r["count"] for r in N.itemsets(items, 0.25, 3).collect()}
    assert sets == {("a",): 3, ("b",): 2, ("c",): 2, ("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1, ("a", "b", "c"): 1}
    rule = {(r.left, r.right): r for r in N.rules(N.itemsets(items, 0.25, 3), 0.0).collect()}["b", "a"]
    assert rule.confidence == 1.0 and rule.lift == pytest.approx(4 / 3) and rule.leverage == pytest.approx((2 * 4 - 2 * 3) / 16)


def test_graph(spark):
    from tarnwork.plans.registry import shared_checkpoints

    shared_checkpoints(spark)
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (3, 6)], "src long, dst long")
    assert {r.id: r.links for r in G.triangles(e).collect()} == {1: 1, 2: 1, 3: 1}
    assert {r.id: r.component for r in G.components(e).collect()} == {1: 1, 2: 1, 3: 1, 6: 1, 4: 4, 5: 4}
    assert {r.id: r.distance for r in G.shortest_paths(e, 1).collect()} == {1: 0, 2: 1, 3: 1, 6: 2}


def test_learners(spark):
    df = spark.createDataFrame([(float(i), float(2 * i + 1), "a" if i < 50 else "b") for i in range(100)], "x double, z double, y string")
    m = L.LinearRegression(["x"], "z").fit(df)
    assert m.coefficients == pytest.approx([1, 2]) and m.statistics["r2"] == pytest.approx(1)
    assert L.Lasso(["x"], "z", 0.0).fit(df).coefficients == pytest.approx([1, 2], abs=1e-3)
    tree = L.Tree(["x"], [], "y", 2, 5).fit(df)
    assert tree.transform(df).where("y <> prediction").count() <= 4 and "x <=" in tree.dump()
    assert L.agglomerate(np.array([[0, 1, 9], [1, 0, 8], [9, 8, 0]]), "single") == [(0, 1, 1.0), (3, 2, 8.0)]


def test_evaluation(spark):
    p = spark.createDataFrame([(1, 0, "1", "1", 0.9), (2, 0, "0", "1", 0.6), (3, 0, "1", "0", 0.6), (4, 0, "0", "0", 0.1)], "row long, fold int, actual string, predicted string, p double")
    assert E.auc(p).first().auc == pytest.approx(0.875)
    assert E.auc(p.where("actual = '1'")).first().auc is None
    assert E.binary_measures(p.where("predicted = '0' and actual = '0'")).first().sensitivity is None
    assert E.nemenyi_cd(4, 30) == pytest.approx(0.8564, abs=1e-3)


def test_distribution_functions():
    assert C.chisqprob(3.841458820694124, 1) == pytest.approx(0.05) and C.tprob(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert C.fprob(2, 10, 4.102821015) == pytest.approx(0.05, abs=1e-6) and C.zprob(1.959963985) == pytest.approx(0.975)
    assert C.bell(5) == 52 and C.stirling2(5, 2) == 15 and C.logcomb(10, 3) == pytest.approx(math.log(120))
    assert C.loess([(float(i), 2.0 * i) for i in range(20)], [5.0, 7.5]) == pytest.approx([10, 15])
