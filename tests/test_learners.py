"""Kernel machines, clustering trees, corrected rules, local regression and related learners against plain computations on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.operators import kernel as K
from tarnwork.operators import rules

SF = "/root/testdata/sf0.001"


# -- kernel machines: the conditions of the one best solution hold over all rows ----------------------


def bent(n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(-1, 1, (n, 2)), 3)
    return x, x[:, 0] ** 2 + x[:, 1] + rng.normal(0, 0.1, n)


def machine(spark, monkeypatch, x, t, block=40, **options):
    monkeypatch.setattr(K, "BLOCK", block)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, t, strict=True)], "a double, b double, t double").repartition(5)
    return K.Machine(["a", "b"], **options).fit(df, None if options["kind"] == "one_class" else "t")


def weights_of(m, x):
    """Each row's coefficient, and its decision by the plain sum."""
    own = {tuple(s): c for s, c in zip(m.support.tolist(), m.coefficients, strict=True)}
    gram = np.array([[float(m.kernel.matrix(p[None], q[None])[0, 0]) for q in x] for p in x])
    w = np.array([own.get(tuple(r), 0.0) for r in x.tolist()])
    return w, gram @ w + m.bias, gram


@pytest.mark.parametrize("kind", ["rbf", "linear", "polynomial", "sigmoid"])
def test_c_classes(spark, monkeypatch, kind):
    x, z = bent(230)
    y = np.where(z > 0.4, 1.0, -1.0)
    m = machine(spark, monkeypatch, x, y, kind="c_svc", c=2.0, weights=(1.0, 3.0), kernel=K.Kernel(kind, 1.5 if kind != "sigmoid" else 0.1, 2, 1.0))
    w, d, gram = weights_of(m, x)
    a, top = w * y, np.where(y > 0, 6.0, 2.0)
    assert (a >= -1e-9).all() and (a <= top + 1e-9).all() and abs(w.sum()) < 1e-8
    # Inside the bounds on the margin, without weight beyond it, at the top within it.
    slack = 4e-3
    assert (y * d)[a < 1e-9].min() > 1 - slack and (y * d)[a > top - 1e-9].max(initial=-9) < 1 + slack
    assert np.abs((y * d)[(a > 1e-9) & (a < top - 1e-9)] - 1).max(initial=0) < slack
    if kind != "sigmoid":  # primal and dual value meet
        primal, dual = w @ gram @ w / 2 + (top * np.maximum(0, 1 - y * d)).sum(), a.sum() - w @ gram @ w / 2
        assert abs(primal - dual) < 1e-2 * abs(dual)


def test_nu_classes(spark, monkeypatch):
    x, z = bent(230, 1)
    y = np.where(z > 0.4, 1.0, -1.0)
    m = machine(spark, monkeypatch, x, y, kind="nu_svc", nu=0.3, kernel=K.Kernel("rbf", 2.0))
    w, d, _ = weights_of(m, x)
    a, top = w * y, 1 / m.scale
    for s in (-1, 1):
        assert abs(a[y == s].sum() - 0.3 * 230 / 2 * top) < 1e-6 * top
    slack = 4e-3 / m.scale
    assert (y * d)[a < 1e-9].min() > 1 - slack and (y * d)[a > top - 1e-9].max() < 1 + slack
    with pytest.raises(ValueError, match="nu is at most"):
        machine(spark, monkeypatch, x, y, kind="nu_svc", nu=0.99)


def test_one_class(spark, monkeypatch):
    x, _ = bent(230, 2)
    m = machine(spark, monkeypatch, x, np.ones(230), kind="one_class", nu=0.2, kernel=K.Kernel("rbf", 2.0))
    w, d, _ = weights_of(m, x)
    assert abs(w.sum() - 0.2 * 230) < 1e-6 and w.max() < 1 + 1e-9
    assert d[w < 1e-9].min() > -4e-3 and d[w > 1 - 1e-9].max() < 4e-3
    assert 0.1 < (d < 0).mean() < 0.25


@pytest.mark.parametrize("kind", ["epsilon_svr", "nu_svr"])
def test_values(spark, monkeypatch, kind):
    x, z = bent(230, 3)
    m = machine(spark, monkeypatch, x, z, kind=kind, c=3.0, nu=0.4, epsilon=0.1, kernel=K.Kernel("rbf", 2.0))
    w, d, _ = weights_of(m, x)
    off, slack = z - d, 4e-3
    assert abs(w.sum()) < 1e-8 and np.abs(w).max() < 3 + 1e-9
    assert np.abs(off)[np.abs(w) < 1e-9].max() < m.width + slack
    assert (off * np.sign(w))[np.abs(w) > 3 - 1e-9].min() > m.width - slack
    assert np.abs((off * np.sign(w))[(np.abs(w) > 1e-9) & (np.abs(w) < 3 - 1e-9)] - m.width).max() < slack
    if kind == "nu_svr":
        assert abs(np.abs(w).sum() - 3 * 0.4 * 230) < 1e-6 * 230


def test_machine_on_odd_tables(spark):
    """Unknown values, one class, no rows, a bound on support vectors, more classes than two, other columns."""
    rows = [(k, float(k % 10), "abc"[k % 10 // 4], "x") for k in range(60)] + [(60, None, "a", "x"), (61, 3.0, None, "x")]
    df = spark.createDataFrame(rows, "id long, v double, c string, decision2 string")
    got = {r.id: r.prediction for r in K.SVM(["v"], "c", options={"c": 100.0}, kernel=K.Kernel(gamma=9.0)).fit(df).transform(df).collect()}
    assert all(got[k] == "abc"[k % 10 // 4] for k in range(60)) and got[60] is None and got[61] == "a"
    one = df.where("c = 'a' or c is null")
    assert {r.prediction for r in K.SVM(["v"], "c").fit(one).transform(df).collect()} == {"a", None}
    assert {r.prediction for r in K.SVM(["v"], "c").fit(df.limit(0)).transform(df).collect()} == {None}
    assert K.SVM(["v"], None, "one_class").fit(df.limit(0)).transform(df).count() == 62
    with pytest.raises(ValueError, match="have or may have weight"):
        K.SVM(["v"], "v", "nu_svr", options={"nu": 0.9, "max_support": 5}).fit(df)


def test_machine_queries(spark):
    from tarnwork.plans import learners

    for name, column, least in (("l12_rbf", "y", 0.97), ("l12_nu", "y", 0.95), ("l12_several_classes", "three", 0.95), ("l10_ordered", "three", 0.8), ("l10_corrected", "y", 0.9)):
        t = getattr(learners, name)(spark, SF)
        assert t.where(F.col(column) == F.col("prediction")).count() > least * t.count()
    for name in ("l12_regression", "l12_nu_regression"):
        assert getattr(learners, name)(spark, SF).agg(F.max(F.abs(F.col("z") - F.col("prediction")))).first()[0] < 0.35
    inside = [r.prediction for r in learners.l12_one_class(spark, SF).collect()]
    assert 0.9 < sum(inside) / len(inside) < 1


# -- clustering trees: every level's splits by trying them all -----------------------------------------


def brute_tree(rows, columns, targets, measure, depth, min_rows):
    """Splits as nested tuples (column, cut or None, branches); rows are dicts, targets are numbers or places."""

    def mean(part, t):
        known = [r[t] for r in part if r[t] is not None]
        return sum(known) / len(known) if known else 0.0

    def inside(part):
        return sum((r[t] - mean(part, t)) ** 2 for t in targets for r in part if r[t] is not None) / len(part)

    def gini(part):
        out = 0.0
        for t in targets:
            known = [r[t] for r in part if r[t] is not None]
            out += 1 - sum((known.count(v) / len(known)) ** 2 for v in set(known)) if known else 0
        return out / len(targets)

    def score(parts):
        if measure == "inter":
            pairs = [(a, b) for i, a in enumerate(parts) for b in parts[i + 1 :]]
            return sum((mean(a, t) - mean(b, t)) ** 2 for a, b in pairs for t in targets) / len(pairs)
        if measure == "intra":
            return -sum(map(inside, parts))
        return -sum(len(p) * gini(p) for p in parts) / sum(map(len, parts))

    def grow(part, level):
        tried = []
        for c, kind in sorted(columns.items()):
            known = [r for r in part if r[c] is not None]
            values = sorted({r[c] for r in known})
            options = [(v, [[r for r in known if r[c] <= v], [r for r in known if r[c] > v]]) for v in values[:-1]] if kind == "c" else [(None, [[r for r in known if r[c] == v] for v in values])] if len(values) > 1 else []
            tried += [(-round(score(o), 9), c, cut, o, values) for cut, o in options if min(map(len, o)) >= min_rows]
        if level == depth or not tried:
            return None
        s, c, cut, o, values = min(tried, key=lambda x: x[:2] + (x[2] or 0,))
        if (measure == "inter" and -s <= 1e-9) or (measure == "gini" and -s <= -gini(part) + 1e-9):
            return None
        return c, cut, {k: grow(p, level + 1) for k, p in zip(values if cut is None else ("at most", "more"), o, strict=True)}

    return grow(rows, 0)


def grown(tree, node=1):
    for level in tree.levels:
        for at, c, cut, children in level:
            if at == node:
                names = ("at most", "more") if cut is not None else tree.values[c]
                return c, cut, {n: grown(tree, k) for n, k in zip(names, children, strict=True) if k in tree.prototypes}
    return None


@pytest.mark.parametrize("measure", ["inter", "intra", "gini"])
def test_clustering_tree(spark, measure):
    from tarnwork.operators.clustertree import ClusteringTree

    rng = np.random.default_rng(11)
    rows = []
    for k in range(160):
        a, b, f = float(rng.integers(0, 12)), float(rng.integers(0, 5)), "uvw"[rng.integers(0, 3)]
        rows.append({"a": None if k % 13 == 0 else a, "b": b, "f": None if k % 17 == 0 else f, "t": None if k % 19 == 0 else a * (f == "u") + float(rng.normal()), "u": b - a + float(rng.normal()), "x": "lo" if a < 4 else "hi", "y": None if k % 7 == 0 else "pqr"[int(b) % 3]})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "a double, b double, f string, t double, u double, x string, y string")
    labels = measure == "gini"
    tree = ClusteringTree(["a", "b"], ["f"], [] if labels else ["t", "u"], ["x", "y"] if labels else [], measure, 3, 4).fit(df)
    places = [r | {"x": ["hi", "lo"].index(r["x"]), "y": None if r["y"] is None else "pqr".index(r["y"])} for r in rows]
    want = brute_tree(places, {"a": "c", "b": "c", "f": "d"}, ["x", "y"] if labels else ["t", "u"], measure, 3, 4)
    assert grown(tree) == want and want is not None and tree.dump()
    found = tree.transform(df).collect()
    assert len(found) == 160 and all(r[f"prediction_{c}"] is not None for r in found for c in (("x", "y") if labels else ("t", "u")))
    if not labels:  # a leaf predicts its rows' means
        leaf = [r for r in found if r.leaf == found[1].leaf and r.t is not None]
        below = {c for level in tree.levels for node, *_, cs in level for c in cs if node == found[1].leaf}
        assert below or np.isclose(found[1].prediction_t, np.mean([r.t for r in leaf]))
    empty = ClusteringTree(["a"], ["f"], ["t"]).fit(df.limit(0))
    assert {r.prediction_t for r in empty.transform(df).collect()} == {None}


def test_clustering_tree_queries(spark):
    from tarnwork.plans import learners

    t = learners.l9_clustering_tree(spark, SF)
    assert t.count() == spark.read.parquet(f"{SF}/part.parquet").count() and t.select("leaf").distinct().count() > 3
    t = learners.l9_label_tree(spark, SF)
    assert t.where("y = prediction_y and three = prediction_three").count() > 0.8 * t.count()


# -- rules ---------------------------------------------------------------------------------------------


def brute_rules(rows, names, length):
    """(conditions: (positives, covered)) of all rules up to a length; rows: (dict, positive)."""
    from itertools import combinations, product

    values = {c: sorted({r[c] for r, _ in rows if r[c] is not None}) for c in names}
    out = {}
    for k in range(1, length + 1):
        for cs in combinations(sorted(names), k):
            for vs in product(*(values[c] for c in cs)):
                on = [y for r, y in rows if all(r[c] == v for c, v in zip(cs, vs, strict=True))]
                if on:
                    out[tuple(zip(cs, vs, strict=True))] = (sum(on), len(on))
    return out


def ruled(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        a, b, c = "pqr"[rng.integers(0, 3)], "uv"[rng.integers(0, 2)], str(rng.integers(0, 4))
        y = "yes" if (a == "p" and b == "u") or (c == "3" and a == "r") or rng.random() < 0.1 else "no"
        rows.append((a if k % 23 else None, b, c, y if k % 31 else None))
    return spark.createDataFrame(rows, "a string, b string, c string, y string"), rows


def test_rule_search(spark):
    """With a beam as wide as all rules the best rule is that of a plain search, for each measure."""
    from tarnwork.operators.rules import RuleLearner, chi, laplace, m_estimate, relative_accuracy

    df, rows = ruled(spark)
    known = [(dict(zip("abc", r, strict=False)), r[3] == "yes") for r in rows if r[3] is not None]
    pos, n = sum(y for _, y in known), len(known)
    every = brute_rules(known, "abc", 3)
    for name, f in (("laplace", laplace), ("m", m_estimate(2.0)), ("wracc", relative_accuracy)):
        learner = RuleLearner(["a", "b", "c"], "y", measure=name, beam=1000, length=3, least_covered=4)
        cells = learner.cells(df).withColumns({"_w": F.lit(1.0), "_best": F.lit(0.0)})
        learner.shares = {"yes": pos / n}
        target, rule = learner.best_rule(cells, ["yes"])
        want = min(((-round(f(p, k, pos, n), 12), len(c), c) for c, (p, k) in every.items() if k >= 4 and p))
        assert (round(rule.quality, 12), rule.conditions) == (-want[0], want[2]) and (rule.positives, rule.covered) == every[want[2]]
    assert float(chi(30, 10, 100, 200)) > float(chi(25, 15, 100, 200)) > 0 and chi(5, 20, 100, 200) == 0


def test_best_by_chance(spark):
    """The best statistic over permuted classes: its mean, by length, is that of a plain simulation with all rules tried."""
    from tarnwork.operators.rules import RuleLearner, chi

    df, rows = ruled(spark)
    learner = RuleLearner(["a", "b", "c"], "y", measure="evc", simulations=200, beam=1000, length=3)
    best = learner.best_by_chance(learner.cells(df), "yes")
    known = [(dict(zip("abc", r, strict=False)), r[3] == "yes") for r in rows if r[3] is not None]
    masks = {c: np.array([all(r[x] == v for x, v in c) for r, _ in known]) for c in brute_rules(known, "abc", 3)}
    rng, want = np.random.default_rng(0), []
    y = np.array([v for _, v in known])
    for _ in range(200):
        rng.shuffle(y)
        top = [0.0] * 3
        for c, on in masks.items():
            x = float(chi(y[on].sum(), on.sum() - y[on].sum(), y.sum(), len(y) - y.sum()))
            for k in range(len(c) - 1, 3):
                top[k] = max(top[k], x)
        want.append(top)
    want = np.array(want)
    assert (np.diff(best, axis=1) >= 0).all()
    assert np.allclose(best.mean(0), want.mean(0), rtol=0.12) and np.allclose(best.std(0), want.std(0), rtol=0.35)
    assert [e.mu for e in learner.fit_extremes(best)] == sorted(e.mu for e in learner.fit_extremes(best))


def test_corrected_qualities():
    """A correction takes away what chance explains, no more than all of it, less from what is less likely; its parts agree with their definitions."""
    from tarnwork.operators.rules import Extreme, RuleLearner, chi, chi_tail

    learner, by = RuleLearner([], "y"), Extreme(8.0)
    kept = [learner.corrected(p, 40, 300, 1000, by) for p in range(10, 40)]
    assert kept[0] == 10 and all(k <= p + 1e-9 for k, p in zip(kept, range(10, 40), strict=True)) and kept == sorted(kept)
    assert kept[6] == 40 * 0.3 and kept[-1] > 34
    p = 30.0
    value = float(chi(p, 10, 300, 700))
    least = by.corrected(value)
    assert np.isclose(chi_tail(least), 1 - np.exp(-np.exp((8.0 - value) / 2)), rtol=1e-6)
    assert np.isclose(float(chi(kept[20], 40 - kept[20], 300, 700)), least, rtol=1e-6)
    assert np.isclose(by.median, 8 + 2 * 0.36651292)
    assert learner.corrected(40, 40, 300, 1000, by) < 40 and learner.corrected(20, 40, 300, 1000, Extreme(1.0)) == 20


@pytest.mark.parametrize(("covering", "measure"), [("ordered", "laplace"), ("unordered", "laplace"), ("weighted", "wracc"), ("probable", "evc")])
def test_rules_find_what_is_planted(spark, covering, measure):
    from tarnwork.operators.rules import RuleLearner

    df, _ = ruled(spark, 400)
    learner = RuleLearner(["a", "b", "c"], "y", covering, measure, length=2, least_covered=8, simulations=20, factor=0.1, least_improved=8).fit(df)
    found = [r.conditions for t, r in learner.rules if t == "yes"]
    assert (("a", "p"), ("b", "u")) in found and (covering == "weighted" or (("a", "r"), ("c", "3")) in found)
    got = learner.transform(df).where("y is not null")
    assert got.where("y = prediction").count() > (0.8 if covering != "weighted" else 0.7) * got.count()
    if covering == "ordered":
        assert len(RuleLearner(["a"], "y", covering).fit(df.limit(0)).transform(df).where("prediction is null").collect()) == 400
        assert RuleLearner(["a"], "y", "unordered").fit(df.where("y = 'no'")).transform(df).where("prediction = 'no'").count() == 400


# -- local regression ------------------------------------------------------------------------------------


def test_loess_curve(spark):
    """Equal to fits over plain lists, for several windows, ties and partitions, inside and outside the points' span."""
    from tarnwork.functions.stats import loess
    from tarnwork.operators import local

    rng = np.random.default_rng(2)
    rows = [(float(round(x, 1)), float(np.sin(x) + rng.normal(0, 0.1)), float(x > 5)) for x in rng.uniform(0, 10, 300)] + [(None, 1.0, 0.0), (3.0, None, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    at = [-1.0, 0.0, 0.05, 3.33, 5.0, 9.9, 12.0]
    known = [r for r in rows if None not in r]
    for window, parts in ((0.05, 1), (0.3, 7), (1.0, 3)):
        got = local.loess_curve(df.repartition(parts), "x", [F.col("y"), F.col("z")], at, window)
        for k in (0, 1):
            assert np.allclose(got[:, k], loess([(r[0], r[k + 1]) for r in known], at, window), rtol=1e-6, atol=1e-9)
    one = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "x double, y double")
    assert np.allclose(local.loess_curve(one, "x", [F.col("y")], [1.0, 5.0])[:, 0], 3.0)
    assert np.isnan(local.loess_curve(one.limit(0), "x", [F.col("y")], [1.0])).all() and local.curve_points(one.limit(0), "x") == []


def test_loess_rows(spark):
    """Each value's fit over its k nearest, whatever the blocks."""
    from tarnwork.operators import local

    rng = np.random.default_rng(4)
    xs = np.round(np.concatenate([rng.uniform(0, 4, 150), rng.uniform(3, 30, 60)]), 1)
    rows = [(float(x), float(x * x + rng.normal())) for x in xs]
    df = spark.createDataFrame(rows, "x double, y double")
    values = sorted(set(xs))
    for k, block in ((1, 2), (4, 8), (7, 1000)):
        got = {r.x: r.estimate for r in local.loess_rows(df, "x", "y", k, block).collect()}
        assert sorted(got) == values
        for x0 in values:
            far = sorted(abs(v - x0) for v in values)[k - 1]
            near = [(x, y) for x, y in rows if abs(x - x0) <= far]
            w = np.array([(1 - (abs(x - x0) / ((far or 1) * local.BEYOND)) ** 3) ** 3 for x, _ in near])
            x, y = np.array(near).T
            mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
            sxx = (w * (x - mx) ** 2).sum()
            want = my + ((w * (x - mx) * (y - my)).sum() / sxx if sxx > 1e-9 * (w * (x - x0) ** 2).sum() and sxx > 1e-12 else 0) * (x0 - mx)
            assert np.isclose(got[x0], want, rtol=1e-5, atol=1e-6), (k, block, x0)


def test_loess_bayes(spark):
    from tarnwork.operators import local
    from tarnwork.plans import learners

    rows = [(float(k % 40), float(k % 7), "in" if 10 <= k % 40 < 25 else "out") for k in range(400)] + [(None, None, "in"), (15.0, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, y string")
    model = local.LoessBayes(["a", "b"], "y", 0.15).fit(df)
    got = model.transform(df).collect()
    assert sum(r.y == r.prediction for r in got) > 370 and got[401].prediction == "in" and all(abs(sum(r.probability) - 1) < 1e-9 for r in got)
    assert got[400].prediction == max(model.prior, key=model.prior.get) and np.isclose(got[400].probability[0], model.prior["in"])
    at, curve = model.curves["a"]
    x = local.interpolated(F.lit(7.3), at, curve[:, 0])
    assert np.isclose(spark.range(1).select(x).first()[0], np.interp(7.3, at, curve[:, 0]))
    assert local.LoessBayes(["a"], "y").fit(df.limit(0)).transform(df).where("prediction is null").count() == 402
    found = learners.l3_loess_bayes(spark, SF)
    assert found.where("three = prediction").count() > 0.7 * found.count()
    assert learners.c10_loess_rows(spark, SF).where("estimate is null").count() == 0 and learners.a32_loess_curve(spark, SF).count() == 20


# -- function decomposition ------------------------------------------------------------------------------


def brute_merge(rows, bound, free, m=2.0, least=0.0):
    """Groups of bound values by trying all pairs again after each merge; rows are dicts with a class y."""
    rows = [r for r in rows if r["y"] is not None]
    classes = sorted({r["y"] for r in rows})
    prior = {y: sum(r["y"] == y for r in rows) / len(rows) for y in classes}
    show = lambda v: "?" if v is None else f"={v}"
    groups = [[b] for b in sorted({tuple(show(r[c]) for c in bound) for r in rows})]
    cells = {}
    for r in rows:
        cells.setdefault((tuple(show(r[c]) for c in free), tuple(show(r[c]) for c in bound)), dict.fromkeys(classes, 0))[r["y"]] += 1

    def cell(f, group):
        found = [cells[f, b] for b in group if (f, b) in cells]
        return {y: sum(c[y] for c in found) for y in classes} if found else None

    def error(c):
        n = sum(c.values())
        return n * (1 - max(c[y] + m * prior[y] for y in classes) / (n + m))

    def profit(g, h):
        out = 0.0
        for f in {f for f, _ in cells}:
            a, b = cell(f, g), cell(f, h)
            if a and b:
                out += error(a) + error(b) - error({y: a[y] + b[y] for y in classes})
        return out

    while len(groups) > 1:
        best = min((-round(profit(g, h), 9), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        if -best[0] <= least + 1e-9:
            break
        groups[best[1]] += groups.pop(best[2])
    return sorted(map(sorted, groups))


def test_merged_feature(spark):
    from tarnwork.operators import decompose

    rng = np.random.default_rng(8)
    rows = []
    for k in range(400):
        a, b, f, g = int(rng.integers(0, 4)), int(rng.integers(0, 3)), int(rng.integers(0, 3)), int(rng.integers(0, 2))
        y = "abc"[(max(a, b) * f + (rng.random() < 0.1)) % 3]
        rows.append({"a": str(a) if k % 37 else None, "b": str(b), "f": str(f), "g": str(g) if k % 29 else None, "y": y if k % 41 else None})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "a string, b string, f string, g string, y string").repartition(4)
    for bound, free in ((["a", "b"], ["f"]), (["a"], ["b", "f", "g"]), (["g"], ["a", "b", "f"])):
        made = decompose.construct(df, bound, free, "y")
        assert sorted(map(sorted, made.groups)) == brute_merge(rows, bound, free), bound
        out = made.transform(df, "made")
        assert out.count() == 400 and out.where("made is null").count() == sum(r["y"] is None and not any(tuple("?" if r[c] is None else f"={r[c]}" for c in bound) in g for g in made.groups) for r in rows)
    assert len(decompose.construct(df, ["a", "b"], ["f"], "y", most_values=2).groups) == 2
    left, made = decompose.redundant(df, ["a", "b", "f", "g"], "y")
    assert "g" not in left and {"a", "b", "f"} <= set(left) and not made
    left, made = decompose.redundant(df, ["a", "b", "f", "g"], "y", keep_values=False)
    assert set(made) == {c for c in left if c.endswith("_r")}
    scores = decompose.im_scores(df, ["a", "b", "f", "g"], "y")
    assert len({round(v, 9) for v in scores.values()}) == 1 and -1 < scores["a"] < 0  # the same cells, whichever is the column
    assert decompose.construct(df.limit(0), ["a"], ["b"], "y").groups == [] and decompose.im_scores(df.limit(0), ["a"], "y") == {"a": 0.0}


def test_decomposition_queries(spark):
    from tarnwork.plans import learners

    t = learners.t34_merged_feature(spark, SF)
    assert {r.made for r in t.collect()} and t.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/part.parquet").count()
    assert "odd" not in learners.p18_redundant(spark, SF).columns


# -- graphs and projections ------------------------------------------------------------------------------


def test_pathfinder(spark):
    """Against the closure of lightest heaviest links over whole matrices, for several lengths."""
    from tarnwork.operators.graph import pathfinder

    rng = np.random.default_rng(6)
    n, w = 14, {}
    for _ in range(45):
        i, j = sorted(rng.choice(14, 2, replace=False).tolist())
        w[i, j] = min(w.get((i, j), 99), int(rng.integers(1, 9)))
    rows = [(j, i, float(v)) if k % 2 else (i, j, float(v)) for k, ((i, j), v) in enumerate(w.items())] + [(i, j, v + 3.0) for (i, j), v in list(w.items())[:5]] + [(3, 3, 1.0), (0, 1, None)]
    df = spark.createDataFrame(rows, "src int, dst int, weight double")
    direct = np.full((n, n), np.inf)
    for (i, j), v in w.items():
        direct[i, j] = direct[j, i] = v
    best = direct.copy()
    for q in range(1, 6):
        if q > 1:
            best = np.minimum(best, np.min(np.maximum(best[:, :, None], direct[None]), axis=1))
        if q != 4:
            got = {(r.src, r.dst) for r in pathfinder(df, q).collect()}
            assert got == {e for e, v in w.items() if best[e] >= v}, q
    assert pathfinder(df.limit(0), 3).count() == 0


@pytest.mark.parametrize("supervised", [False, True])
def test_components(spark, supervised):
    """Against dense matrices: unknown values, a constant column, a share of the variance; the Laplacian of rows of different classes."""
    from tarnwork.operators.projection import Components

    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 4)) @ rng.normal(size=(4, 4)) * [1, 20, 3, 0] + [0, 5, 9, 2]
    x[::11, 1] = np.nan
    y = ["abc"[k % 3] for k in range(90)]
    df = spark.createDataFrame([(*(None if np.isnan(v) else float(v) for v in r), c) for r, c in zip(x, y, strict=True)], "a double, b double, c double, d double, y string")
    means, spread = np.nanmean(x, 0), np.nanstd(x, 0, ddof=1)
    z = np.nan_to_num((x - means) / np.where(spread == 0, 1, spread))
    laplacian = -np.array([[float(p != q) for q in y] for p in y])
    laplacian -= np.diag(laplacian.sum(0))
    want = z.T @ (laplacian if supervised else np.eye(90)) @ z / 89
    values = np.sort(np.linalg.eigvalsh(want))[::-1]
    found = Components(list("abcd"), class_name="y" if supervised else None).fit(df)
    assert np.allclose(found.variances, values, atol=1e-8 * values[0]) and np.isclose(found.variance_sum, values.sum())
    assert np.allclose(want @ found.components.T, found.components.T * found.variances, atol=1e-7 * values[0])
    some = Components(list("abcd"), covered=0.8, class_name="y" if supervised else None).fit(df)
    share = np.cumsum(values) / values.sum()
    assert len(some.components) == int(np.searchsorted(share, 0.8)) + 1
    got = np.array([[r.pc1] for r in found.transform(df).collect()])
    assert np.allclose(got[:, 0], z @ found.components[0])
    with pytest.raises(ValueError, match="constant"):
        Components(["d"]).fit(df)
    with pytest.raises(ValueError, match="no rows"):
        Components(["a"]).fit(df.limit(0))


def test_probable_covering_searches_once(spark, monkeypatch):
    """The beam search counts all rows whatever rules they have, so it is made once for each class; the rules are those of taking the best improvement again and again."""
    rng = np.random.default_rng(3)
    data = [(str(int(a)), str(int(b)), "yes" if (a + b) % 3 == 0 or rng.random() < 0.2 else "no") for a, b in rng.integers(0, 6, (600, 2))]
    df = spark.createDataFrame(data, "a string, b string, y string")
    calls, counted = [], rules.RuleLearner.counted
    monkeypatch.setattr(rules.RuleLearner, "counted", lambda *given: (calls.append(1), counted(*given))[1])
    m = rules.RuleLearner(["a", "b"], "y", covering="probable", measure="m", beam=3, length=2, least_improved=5).fit(df)
    assert len(calls) == 4 and len(m.rules) > 5  # two classes, two lengths
    for target in ("no", "yes"):
        share = sum(y == target for *_, y in data) / len(data)
        at, have, want = lambda r, row: all(row["ab".index(c)] == v for c, v in r.conditions), [share] * len(data), []
        cells = m.cells(df).withColumns({"_w": F.lit(1.0), "_best": F.lit(share)})
        tried = sorted((x for part in m._tried(cells, [target]) for x in part), key=m._order)
        while True:
            found = next((r for _, r in tried if r.quality > share + 1e-3 and sum(at(r, row) and row[2] == target and h < r.quality for row, h in zip(data, have, strict=True)) >= 5), None)
            if found is None:
                break
            want.append(found)
            have = [max(h, found.quality) if at(found, row) else h for row, h in zip(data, have, strict=True)]
        assert [r for t, r in m.rules if t == target] == want
