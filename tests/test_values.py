"""Queries that SQL cannot express, against NumPy or plain Python on the same tables."""

import importlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.plans import registry

for name in ("relations", "statistics", "mining", "sources", "further"):
    importlib.import_module(f"tarnwork.plans.{name}")
SF = "/root/testdata/sf0.001"


def sql(text):
    return duckdb.sql(text.replace("@", f"'{SF}/").replace("~", ".parquet'")).fetchall()


def run(spark, name):
    return registry.QUERIES[name](spark, SF)


def entropy(counts):
    p = np.array([c for c in counts if c], float)
    p /= p.sum()
    return float(-(p * np.log2(p)).sum())


def mdl_cuts(x, y):
    """Entropy cuts accepted by description length, straight from the rows."""
    values = sorted(set(x))
    best = None
    for v in values[:-1]:
        left, right = y[x <= v], y[x > v]
        e = (len(left) * entropy(np.bincount(left)) + len(right) * entropy(np.bincount(right))) / len(y)
        if best is None or e < best[0] - 1e-12:
            best = (e, v, left, right)
    if best is None:
        return []
    e, v, left, right = best
    k, k1, k2 = (len(set(a.tolist())) for a in (y, left, right))
    h, h1, h2 = (entropy(np.bincount(a)) for a in (y, left, right))
    if h - e <= (math.log2(len(y) - 1) + math.log2(3**k - 2) - (k * h - k1 * h1 - k2 * h2)) / len(y):
        return []
    return [*mdl_cuts(x[x <= v], left), v, *mdl_cuts(x[x > v], right)]


def test_entropy_cuts(spark):
    rows = np.array(sql("select l_quantity, l_discount, (l_quantity between 18 and 33)::int from @lineitem~"), float)
    want = {(c, k + 1, float(v)) for j, c in enumerate(("l_quantity", "l_discount")) for k, v in enumerate(mdl_cuts(rows[:, j], rows[:, 2].astype(int)))}
    assert {tuple(r) for r in run(spark, "t3_entropy_cuts").select("attribute", "no", "cut").collect()} == want and want


def test_lasso(spark):
    x = np.array(sql("select l_quantity, l_discount, l_tax, l_quantity * 3 + l_discount as z from @lineitem~"), float)
    n, k = len(x), 3
    a, z = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0), (x[:, 3] - x[:, 3].mean()) / x[:, 3].std()
    w, lam = np.zeros(k), 0.5 * 0.05 * n / k
    for _ in range(500):  # coordinate descent
        for j in range(k):
            r = a[:, j] @ (z - a @ w + a[:, j] * w[j])
            w[j] = np.sign(r) * max(abs(r) - lam, 0) / (a[:, j] @ a[:, j])
    want = (a @ w) * x[:, 3].std() + x[:, 3].mean()
    got = sorted((r.z, r.prediction) for r in run(spark, "l15_lasso").collect())
    assert np.allclose(got, sorted(zip(x[:, 3], want, strict=True)), atol=1e-5)


def test_pca(spark):
    x = np.array(sql("select l_quantity, l_discount, l_tax from @lineitem~ order by all"), float)
    c = x - x.mean(0)
    _, _, v = np.linalg.svd(c, full_matrices=False)
    v *= np.sign(v[np.arange(3), np.abs(v).argmax(1)])[:, None]
    got = np.array([(r.l_quantity, r.l_discount, r.l_tax, r.pc1, r.pc2) for r in run(spark, "l29_pca").orderBy("l_quantity", "l_discount", "l_tax").collect()])
    assert np.allclose(got[:, 3:], c @ v[:2].T, atol=1e-6)


def test_hierarchical(spark):
    from tarnwork.operators import learn as L

    x = np.random.default_rng(5).normal(size=(24, 3))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    clusters = {i: [i] for i in range(len(x))}
    heights = []
    while len(clusters) > 1:
        best = min((d[np.ix_(clusters[a], clusters[b])].mean(), a, b) for a in clusters for b in clusters if a < b)
        heights.append(best[0])
        clusters[best[1]] += clusters.pop(best[2])
    assert [h for _, _, h in L.agglomerate(d, "average")] == pytest.approx(heights)
    got = run(spark, "l26_hierarchical").collect()
    n = sql("select count(*) from @nation~")[0][0]
    assert len(got) == n - 1 and sorted(x for r in got for x in (r.a, r.b)) == list(range(2 * n - 2))
    assert [r.height for r in got] == sorted(r.height for r in got)


def confusion(spark, name, actual="y"):
    t = run(spark, name)
    if "n" in t.columns:
        return {(str(r[actual]), str(r.prediction)): r.n for r in t.collect()}
    return {(str(r[0]), str(r[1])): r[2] for r in t.groupBy(actual, "prediction").count().collect()}


@pytest.mark.parametrize(("name", "actual", "least"), [("l4_logistic", "y", 0.97), ("l7_tree", "c", 0.9), ("l12_svm", "y", 0.9), ("l18_boosting", "y", 0.7), ("l19_forest", "y", 0.9), ("e1_cross_validation", "y", 0.85), ("l13_neural", "y", 0.5)])
def test_learners_learn(spark, name, actual, least):
    found = confusion(spark, name, actual)
    total = sum(found.values())
    assert total == sql("select count(*) from @part~")[0][0]
    assert sum(n for (a, p), n in found.items() if a == p) >= least * total


def test_bagging_votes_for_each_row(spark):
    actual = dict(sql("select p_partkey, (p_size + p_retailprice / 100 >= 35)::int from @part~"))
    got = {r.p_partkey: r.prediction for r in run(spark, "l17_bagging").collect()}
    assert got.keys() == actual.keys() and sum(got[k] == v for k, v in actual.items()) >= 0.85 * len(actual)


def test_rules_by_enumeration(spark):
    """The first rule is the best of all of one or two conditions; every rule is more often right than wrong on what is left."""
    from tarnwork.operators import learn as L
    from tarnwork.plans.mining import _nb

    t = _nb(spark, SF)
    rows = [(r.a, r.b, r.y == "y") for r in t.collect()]
    found = L.learn_rules(t, ["a", "b"], "y", "y", beam=1000)
    tests = [[("a", v)] for v in {r[0] for r in rows}] + [[("b", v)] for v in {r[1] for r in rows}]
    tests += [p + q for p in tests for q in tests if p[0][0] < q[0][0]]
    left, covers = list(rows), lambda rule, r: all(r["ab".index(c)] == v for c, v in rule)
    for rule, quality in found:
        scores = []
        for x in tests:
            own = [r[2] for r in left if covers(x, r)]
            if any(own):
                scores.append((sum(own) + 1) / (len(own) + 2))
        assert quality == pytest.approx(max(scores))
        left = [r for r in left if not (r[2] and covers(rule, r))]
    scores = [(sum(own) + 1) / (len(own) + 2) for x in tests if any(own := [r[2] for r in left if covers(x, r)])]
    assert not scores or max(scores) <= 0.5


@pytest.mark.parametrize(("name", "clusters"), [("l25_kmeans", 4), ("l28_mixture", 2)])
def test_clusters_hold_all_rows(spark, name, clusters):
    got = run(spark, name).collect()
    table = {"l25_kmeans": "lineitem", "l28_mixture": "part"}[name]
    assert len(got) == clusters and sum(r.n for r in got) == sql(f"select count(*) from @{table}~")[0][0]


def test_kmeans_is_a_fixed_point(spark):
    """Rows are with the nearest centre, and centres are near the means of their rows."""
    from tarnwork.operators import learn as L

    t = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_quantity", "l_discount")
    rows = np.array([(r.l_quantity, r.l_discount, r.prediction) for r in L.ml("kmeans", ["l_quantity", "l_discount"], "", k=4, seed=1, maxIter=100)(t)(t).collect()])
    centres = np.array([rows[rows[:, 2] == k, :2].mean(0) for k in range(4)])
    nearest = ((rows[:, None, :2] - centres) ** 2).sum(2).argmin(1)
    assert (nearest == rows[:, 2]).mean() > 0.995


def test_som(spark):
    from tarnwork.operators import projection as J
    from tarnwork.plans.further import _image

    assert sum(r.n for r in run(spark, "l33_som").collect()) == sql("select count(*) from @embeddings~")[0][0]
    rng = np.random.default_rng(0)
    centres = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0], [10.0, 10.0]])
    df = spark.createDataFrame([([float(v) for v in centres[k % 4] + rng.normal(size=2) * 0.3],) for k in range(200)], "v array<double>")
    found = J.som(df, "v", _image(2), 25, 0)
    assert found.assign(df).agg({"error": "avg"}).first()[0] < 0.5
    assert sorted(np.round(found.nodes, 0).tolist()) == sorted(centres.tolist()) and len(found.u_matrix()) == 4


def test_mds(spark):
    from tarnwork.operators import projection as J

    x = np.array([[0.0, 0.0], [3.0, 0.0], [3.0, 4.0], [0.0, 4.0], [1.0, 1.0]])
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    start = np.random.default_rng(2).normal(size=x.shape)
    values = [J.stress(d, J.smacof(d, start, rounds)) for rounds in (0, 1, 5, 300)]
    assert values == sorted(values, reverse=True) and values[-1] < 0.01 * values[0]
    got = run(spark, "l32_mds").collect()
    x = np.array([r[0] for r in sql("select n_nationkey * 7 % 13 from @nation~ order by n_nationkey")], float)
    p = np.array([(r.x, r.y) for r in sorted(got)])
    assert np.allclose(np.sqrt(((p[:, None] - p) ** 2).sum(2)), np.abs(x[:, None] - x) / np.ptp(x), atol=1e-3)  # places on a line


def test_stacking_and_tuning(spark):
    stacked = confusion(spark, "l20_stacking", "label")
    total = sum(stacked.values())
    right = sum(n for (a, p), n in stacked.items() if float(a) == float(p))
    from tarnwork.operators import compose as K
    from tarnwork.plans.further import _folded

    t = _folded(spark, SF)
    for column in "ab":
        own = K.naive_bayes([column], "y")(t)(t).where("prediction = y").count()
        assert right >= 0.98 * own
    assert total == t.count()
    rows = [(r.a, r.b, r.y, r.fold) for r in t.collect()]

    def accuracy(m):
        shares = []
        for fold in range(3):
            train, test = [r for r in rows if r[3] != fold], [r for r in rows if r[3] == fold]
            prior = {c: sum(r[2] == c for r in train) / len(train) for c in "ny"}

            def p(c, j, v):
                same = [r for r in train if r[j] == v]
                return (sum(r[2] == c for r in same) + m * prior[c]) / (len(same) + m) / prior[c] if same else 1.0

            known = {(c, j, v): max(p(c, j, v), 1e-300) for c in "ny" for j in (0, 1) for v in {r[j] for r in rows}}
            guess = [max("ny", key=lambda c: (math.log(prior[c]) + math.log(known[c, 0, r[0]]) + math.log(known[c, 1, r[1]]), c == "n")) for r in test]
            shares.append(sum(g == r[2] for g, r in zip(guess, test, strict=True)) / len(test))
        return sum(shares) / 3

    for r in run(spark, "l21_tuned").collect():
        assert r.ca == pytest.approx(accuracy(r.m), abs=0.011)  # ties may fall either way


def test_model_scores(spark):
    got = {r.attribute: r for r in run(spark, "m16_m17_model_scores").collect()}
    assert [c for c, r in got.items() if r.kept] == ["p_size"] and got["p_size"].forest > 0.5 > got["none"].forest


def test_multilabel(spark):
    from tarnwork.operators import multilabel as B

    table = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0), (5, 1, 0)], "id long, a int, b int")
    near = spark.createDataFrame([(9, 1), (9, 2), (9, 3), (8, 3), (8, 4), (8, 5)], "probe long, neighbour long")
    got = {r.probe: (r.a, r.b, r.a_predicted, r.b_predicted) for r in B.br_knn(near, table, "id", ["a", "b"]).collect()}
    assert got[9] == (pytest.approx(2 / 3), pytest.approx(2 / 3), 1, 1) and got[8][2:] == (0, 0)
    assert {r.probe: (r.a_predicted, r.b_predicted) for r in B.br_knn(near, table, "id", ["a", "b"], "a").collect()}[8] == (1, 0)
    assert {r.probe: r.a_predicted + r.b_predicted for r in B.br_knn(near, table, "id", ["a", "b"], "b").collect()} == {9: 1, 8: 1}
    own = spark.createDataFrame([(k, j) for k in range(1, 6) for j in (k % 5 + 1, (k + 1) % 5 + 1)], "probe long, neighbour long")
    labels = {1: 1, 2: 1, 3: 0, 4: 0, 5: 1}
    count = {k: labels[k % 5 + 1] + labels[(k + 1) % 5 + 1] for k in labels}
    prior = (1 + 3) / (2 + 5)
    like = lambda b, j: (1 + sum(count[k] == j for k in labels if labels[k] == b)) / (3 + sum(v == b for v in labels.values()))
    pairs = spark.createDataFrame([(9, 1), (9, 2), (8, 3), (8, 4)], "probe long, neighbour long")
    got = {r.probe: r.a for r in B.ml_knn(own, pairs, table, "id", ["a", "b"], 2).collect()}
    for probe, j in ((9, 2), (8, 0)):
        assert got[probe] == pytest.approx(prior * like(1, j) / (prior * like(1, j) + (1 - prior) * like(0, j)))


def test_compose(spark):
    from tarnwork.operators import compose as K

    df = spark.createDataFrame([(k, k % 2, ["n", "y"][k % 2]) for k in range(20)], "k long, x int, y string")
    from pyspark.sql import functions as F

    fit = K.preprocessed(lambda train: lambda rows: rows.withColumn("prediction", F.when(F.col("z") > 1, "y").otherwise("n")), lambda t: t.withColumn("z", F.col("x") * 2))
    assert fit(df)(df).where("prediction <> y").count() == 0
    assert K.signed_rank_p([1, 2, 3], [1, 2, 3]) == 1.0 and K.signed_rank_p([1, 2, 3, 4, 5, 6], [2, 3, 4, 5, 6, 7]) < 0.05
    assert len(K.leave_one_out(df, {"m": K.majority("y")}, "k", "y").collect()) == 20
    best = K.best_cutoff(spark.createDataFrame([("1", 0.9), ("1", 0.6), ("0", 0.7), ("0", 0.1)], "actual string, p double")).first()
    assert (best.threshold, best.ca) == (0.6, 0.75)
    _, scores = K.tune_many(df.withColumn("fold", F.col("k") % 2), lambda a, b: K.majority("y"), {"a": [1, 2], "b": [3]}, "fold", 2, "y")
    assert [o for o, _ in scores] == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]


def test_logistic_statistics(spark):
    """Coefficients and errors against Newton's steps in NumPy."""
    rows = np.array(sql("select o_totalprice / 100000, o_custkey / 1000, (o_orderkey % 7 / 7 + o_totalprice / 400000 > 0.9)::int from @orders~"), float)
    x, y, b = np.column_stack([np.ones(len(rows)), rows[:, :2]]), rows[:, 2], np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        h = x.T @ (x * (p * (1 - p))[:, None])
        b = b + np.linalg.solve(h, x.T @ (y - p))
    got = run(spark, "l4_statistics").collect()
    assert [r.beta for r in got] == pytest.approx(b, rel=1e-5) and [r.se for r in got] == pytest.approx(np.sqrt(np.diag(np.linalg.inv(h))), rel=1e-5)
    assert all(r.p == pytest.approx(math.erfc(abs(r.beta / r.se) / math.sqrt(2)), rel=1e-6) for r in got)


def test_fisher(spark):
    """The direction is the inverse of the spread inside times the difference of means, but for its length."""
    x = np.array(sql("select p_size, p_retailprice, (p_size >= 25)::int from @part~ order by p_partkey"), float)
    a, b = x[x[:, 2] == 0, :2], x[x[:, 2] == 1, :2]
    inside = (np.cov(a.T, bias=True) * len(a) + np.cov(b.T, bias=True) * len(b)) / len(x)
    want = x[:, :2] @ np.linalg.solve(inside, b.mean(0) - a.mean(0))
    got = np.array([r.fd1 for r in run(spark, "l29_fisher").orderBy("p_partkey").collect()])
    assert abs(np.corrcoef(got, want)[0, 1]) > 1 - 1e-9


def test_kendall_of_ties(spark):
    from tarnwork.functions import stats as C

    rng = np.random.default_rng(6)
    for n, high in ((60, 8), (45, 1000), (7, 2)):
        x, y = rng.integers(0, high, n), rng.integers(0, max(high // 2, 2), n)
        s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(n) for j in range(i))
        n1, n2 = (sum(v[i] != v[j] for i in range(n) for j in range(i)) for v in (x, y))
        df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (1, None)], "x int, y double")
        assert C.kendall(df, "x", "y").first().tau == pytest.approx(s / math.sqrt(n1 * n2))


# -- unknown and odd values ----------------------------------------------------------------------------


def test_impute_model_leaves_predictors_alone(spark):
    from tarnwork.operators.transform import impute_model

    rows = [(1, 1.0, 2.0, 5.0), (2, 2.0, 1.0, 4.0), (3, 3.0, None, None), (4, 4.0, 4.0, 12.0), (5, 5.0, None, 8.0), (6, None, 3.0, None)]
    df = spark.createDataFrame(rows, "id int, a double, b double, t double").withColumn("_y", F.lit(1))
    got = {r.id: r for r in impute_model(df, "t", ["a", "b"]).collect()}
    a, b = np.array([1, 2, 4, 5.0]), np.array([2, 1, 4, 2.5])  # b's mean is 2.5
    w = np.linalg.lstsq(np.column_stack([np.ones(4), a, b]), np.array([5, 4, 12, 8.0]), rcond=None)[0]
    assert [got[k].b for k in (3, 5)] == [None, None] and got[6].a is None and got[5].t == 8.0
    assert np.isclose(got[3].t, w @ [1, 3, 2.5]) and np.isclose(got[6].t, w @ [1, 3, 3])  # a's mean is 3
    assert impute_model(df.where("t is null"), "t", ["a", "b"]).where("t is null").count() == 2


def test_relief_with_unknown_values(spark):
    """Against a plain loop: unknown and discrete values, ties with the kth, rows at no distance, a class, and a value."""
    from tarnwork.operators.scoring import relief

    rng = np.random.default_rng(7)
    rows = [(k, None if k % 5 == 0 else float(rng.integers(0, 8)), None if k % 7 == 0 else "xyz"[rng.integers(0, 3)], "pqr"[k % 3] if k % 11 else None, float(rng.normal())) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, a double, f string, y string, v double")
    for target, regression in (("y", False), ("v", True)):
        own = [(k, a, f, y if target == "y" else v) for k, a, f, y, v in rows if (y if target == "y" else v) is not None]
        known = [a for _, a, _, _ in own if a is not None]
        span, mean = max(known) - min(known), np.mean(known)
        p = {x: sum(f == x for _, _, f, _ in own) / sum(f is not None for _, _, f, _ in own) for x in "xyz"}
        da = lambda a, b: 0.5 if a is None and b is None else abs((mean if a is None else a) - (mean if b is None else b)) / span
        df_ = lambda a, b: 1 - sum(x * x for x in p.values()) if a is None and b is None else 1 - p[a or b] if a is None or b is None else float(a != b)
        n_of = {c: sum(r[3] == c for r in own) for c in {r[3] for r in own}}
        top = max(r[3] for r in own) if regression else 0
        sums, n_c = {"a": [0.0, 0.0], "f": [0.0, 0.0]}, 0.0
        for r in own:
            for c in [None] if regression else n_of:
                near = sorted((round(da(r[1], o[1]) + df_(r[2], o[2]), 12), o) for o in own if o[0] != r[0] and c in (None, o[3]) and da(r[1], o[1]) + df_(r[2], o[2]) > 0)
                near = [o for d, o in near if d <= near[min(4, len(near)) - 1][0]]
                for o in near:
                    w = abs(r[3] - o[3]) / (top - min(x[3] for x in own)) if regression else -1 if o[3] == r[3] else n_of[c] / (len(own) - n_of[c])
                    n_c += w / len(near)
                    for name, d in (("a", da(r[1], o[1])), ("f", df_(r[2], o[2]))):
                        sums[name][0] += w * d / len(near)
                        sums[name][1] += d / len(near)
        m = len(own)
        want = {c: w / n_c - (b - w) / (m - n_c) if regression else w / m for c, (w, b) in sums.items()}
        got = {r.attribute: r.relief for r in relief(df.select("k", "a", "f", target), ["a"], target, "k", 100, 4, ["f"], regression).collect()}
        assert got.keys() == want.keys() and all(np.isclose(got[c], want[c]) for c in want), (target, got, want)


def test_odd_values_in_text_formats(spark, tmp_path):
    from tarnwork.schema import Domain, Variable, convert
    from tarnwork.sources import readers, writers

    odd = ["plain", "a,b", "50% c", "it's", 'say "x"', "back\\slash", "", "?", " lead", "{x}", "two\nlines", "\\n", "tab\there", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(odd)], "n int, s string").select(F.col("n").cast("double").alias("n"), "s")
    df = convert(df, Domain((Variable("n"), Variable("s", "string", "meta"))))
    path = f"file://{tmp_path}/odd.arff"
    writers.write_arff(df, path)
    assert {int(r.n): r.s for r in readers.read_arff(spark, path).collect()} == dict(enumerate(odd))
    for write, bad in ((writers.write_tab, "tab\there"), (writers.write_prefixed, "tab\there"), (writers.write_tab, "two\nlines")):
        with pytest.raises(Exception, match="holds what parts values"):
            write(df.where(F.col("s") == bad), f"file://{tmp_path}/bad")
    (tmp_path / "c.arff").write_text("% top\n@relation r\n@attribute 'a b' {'x, y', z}\n@attribute s string\n@data\n'x, y', '50% off' % a comment\n% all of it\nz, ?\n{0 'x, y', 1 'k, l'}\n")
    got = readers.read_arff(spark, f"file://{tmp_path}/c.arff")
    assert [tuple(r) for r in got.collect()] == [("x, y", "50% off"), ("z", None), ("x, y", "k, l")] and got.columns == ["a b", "s"]


def test_tree_on_an_empty_table(spark):
    from tarnwork.operators.learn import Tree

    df = spark.createDataFrame([(None, "a", "x")], "v double, f string, y string")
    for some in (df.limit(0), df):
        tree = Tree(["v"], ["f"], "y").fit(some)
        assert {r.prediction for r in tree.transform(df).collect()} == {None if some is not df else "x"} and tree.dump()
