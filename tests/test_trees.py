"""Full trees against a plain recursive construction, row by row with weights, on tables with unknown values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.operators.trees import DecisionTree

SF = "/root/testdata/sf0.001"


def mixed(n=90, seed=3, classes=("a", "b", "c")):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x, z, f = float(np.round(rng.uniform(0, 5), 1)), float(rng.integers(0, 6)), "pqr"[rng.integers(3)]
        score = x + (2 if f == "p" else 0) + rng.normal(0, 0.7)
        y = classes[min(int(score / 7 * len(classes)), len(classes) - 1)] if score > 0 else classes[0]
        out.append((i, None if i % 7 == 0 else x, float("nan") if i % 11 == 0 else z, None if i % 5 == 0 else f, None if i % 17 == 0 else y, round(score, 3)))
    return out


SCHEMA = "id int, x double, z double, f string, y string, v double"


def impurity(rows, measure):
    w = sum(k for *_, k in rows)
    if w <= 0:
        return 0.0
    if measure == "variance":
        mean = sum(k * y for _, y, k in rows) / w
        return sum(k * (y - mean) ** 2 for _, y, k in rows)
    shares = {}
    for _, y, k in rows:
        shares[y] = shares.get(y, 0) + k
    return w - sum(v * v for v in shares.values()) / w if measure == "gini" else -sum(v * math.log2(v / w) for v in shares.values())


def grow(rows, kinds, measure, branches, unknown, depth, least):
    """rows: [(values by column, target, weight)]. A leaf is its rows; a split (column, cut, {branch: tree}, where)."""
    n = sum(k for *_, k in rows)
    whole = impurity(rows, measure)
    if depth == 0 or n < 2 * least - 1e-9 or whole <= 1e-9:
        return rows
    tried = []
    for c in sorted(kinds):
        known = [r for r in rows if r[0][c] is not None]
        seen = sorted({r[0][c] for r in known})
        if kinds[c] == "c":
            ways = [(("cut", a), lambda v, a=a: int(v > a)) for a in seen[:-1]]
        elif branches == "values":
            ways = [(("values",), lambda v: v)] if len(seen) > 1 else []
        else:
            sets = [s for b in range(1, 2 ** len(seen) - 1) if (s := [v for j, v in enumerate(seen) if b >> j & 1]) and (branches == "subset" or len(s) == 1)]
            ways = [(("set", tuple(s)), lambda v, s=s: int(v not in s)) for s in sets]
        for what, way in ways:
            parts = {}
            for r in known:
                parts.setdefault(way(r[0][c]), []).append(r)
            sizes = [sum(k for *_, k in p) for p in parts.values()]
            if len(parts) < 2 or min(sizes) < least - 1e-9:
                continue
            gain = impurity(known, measure) - sum(impurity(p, measure) for p in parts.values())
            gain = gain / whole if measure == "variance" else gain / n
            if measure == "gain_ratio":
                gain /= -sum(s / sum(sizes) * math.log2(s / sum(sizes)) for s in sizes)
            tried.append((-round(gain, 9), c, what, gain, way, parts))
    if not tried or max(t[3] for t in tried) <= 1e-9:
        return rows
    _, c, what, _, way, parts = min(tried, key=lambda t: t[:3])
    lost = [r for r in rows if r[0][c] is None]
    sizes = {b: sum(k for *_, k in p) for b, p in parts.items()}
    cut = None
    if what[0] == "cut":
        cut = (what[1] + min(r[0][c] for r in parts[1])) / 2
    share = spread(sizes, unknown)
    kids = {b: p + [(v, y, k * share[b]) for v, y, k in lost if share.get(b)] for b, p in parts.items()}
    if unknown == "branch" and lost:
        kids["?"] = lost
    elif unknown == "branch":
        share = spread(sizes, "shares")
        kids = dict(parts)
    return (c, cut, way, {b: grow(p, kinds, measure, branches, unknown, depth - 1, least) for b, p in kids.items()}, sizes, rows)


def spread(sizes, mode):
    if mode == "shares":
        return {b: s / sum(sizes.values()) for b, s in sizes.items()}
    if mode == "common":
        return {max(sorted(sizes), key=lambda b: sizes[b]): 1.0}
    return dict.fromkeys(sizes, 1.0) if mode == "all" else {}


def rows_of(tree):
    return tree[5] if isinstance(tree, tuple) else tree


def weigh(tree):
    return sum(k for *_, k in rows_of(tree))


def answer(tree, row, mode, w=1.0):
    """[(leaf's rows, weight)]"""
    if not isinstance(tree, tuple):
        return [(tree, w)]
    c, cut, way, kids, _, rows = tree
    v = row[c]
    b = None if v is None else (int(v > cut) if cut is not None else way(v))
    if b in kids:
        return answer(kids[b], row, mode, w)
    if mode == "ignore":
        return [(rows, w)]
    if mode == "branch" and "?" in kids:
        return answer(kids["?"], row, mode, w)
    share = spread({b: weigh(k) for b, k in kids.items() if b != "?"}, "shares" if mode == "branch" else mode)
    return [a for b, s in share.items() for a in answer(kids[b], row, mode, w * s)]


CASES = [
    ("gain_ratio", "values", "shares", "shares"), ("info_gain", "one", "common", "common"), ("gini", "values", "all", "all"), ("gini", "one", "branch", "branch"), ("info_gain", "values", "ignore", "ignore"),
    ("variance", "subset", "shares", "shares"), ("variance", "values", "common", "all"), ("variance", "one", "ignore", "shares"),
]


@pytest.mark.parametrize(("measure", "branches", "unknown", "at"), CASES)
def test_tree_equals_plain_recursion(spark, measure, branches, unknown, at):
    data = mixed()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    target = "v" if measure == "variance" else "y"
    tree = DecisionTree(["x", "z"], ["f"], target, measure, branches, unknown, at, depth=3, min_rows=4).fit(df)
    plain = [({"x": x, "z": None if math.isnan(z) else z, "f": f}, v if measure == "variance" else y, 1.0) for _, x, z, f, y, v in data]
    want = grow([r for r in plain if r[1] is not None], {"x": "c", "z": "c", "f": "d"}, measure, branches, unknown, 3, 4)
    assert isinstance(want, tuple) and tree.size() > 3 and tree.dump()
    got = {r.id: r for r in tree.transform(df).collect()}
    for (i, *_), (row, _, _) in zip(data, plain, strict=True):
        found = answer(want, row, at)
        total = sum(w for _, w in found)
        if measure == "variance":
            mean = sum(w * sum(k * y for _, y, k in rows) / sum(k for *_, k in rows) for rows, w in found) / total
            assert math.isclose(got[i].prediction, mean, rel_tol=1e-9, abs_tol=1e-9)
        else:
            p = [sum(w * sum(k for _, y, k in rows if y == c) / sum(k for *_, k in rows) for rows, w in found) / total for c in "abc"]
            assert np.allclose(got[i].probability, p, atol=1e-9)


def test_subsets_of_two_classes_and_weights(spark):
    data = mixed(120, 5, ("a", "b"))
    df = spark.createDataFrame(data, SCHEMA).where("y is not null").withColumn("k", F.lit(1.0) + F.col("id") % 3)
    tree = DecisionTree(["x"], ["f"], "y", "gini", "subset", "shares", depth=2, min_rows=6, weight="k").fit(df)
    plain = [({"x": x, "f": f}, y, 1.0 + i % 3) for i, x, _, f, y, _ in data if y is not None]
    want = grow(plain, {"x": "c", "f": "d"}, "gini", "subset", "shares", 2, 6)
    got = {r.id: r.probability for r in tree.transform(df).collect()}
    for (row, _, _), (i, *_) in zip(plain, [r for r in data if r[4] is not None], strict=True):
        found = answer(want, row, "shares")
        p = [sum(w * sum(k for _, y, k in rows if y == c) / sum(k for *_, k in rows) for rows, w in found) / sum(w for _, w in found) for c in "ab"]
        assert np.allclose(got[i], p, atol=1e-9)
    with pytest.raises(ValueError):
        DecisionTree(["x"], ["f"], "y", branches="subset").fit(spark.createDataFrame(mixed(), SCHEMA))


def test_pruning(spark):
    df = spark.createDataFrame(mixed(150, 8), SCHEMA)
    tree = DecisionTree(["x", "z"], ["f"], "y", "info_gain", depth=6, min_rows=1).fit(df)

    def plain(i, m, tree=tree):  # (nodes left, expected error), from the sums alone
        root, sums, kids = tree.nodes[0].sums, tree.nodes[i].sums, [k for k in dict.fromkeys(tree.nodes[i].kids) if k is not None]
        if tree.numeric:
            squares = lambda n, s, q: q - s * s / n
            own = (squares(*sums) + m * squares(*root) / root[0]) / (sums[0] + m)
        else:
            own = 1 - max((v + m * p / root[0]) / (sums[0] + m) for v, p in zip(sums[1:], root[1:], strict=True))
        under = [plain(k, m, tree) for k in kids]
        below = sum(e * tree.nodes[k].sums[0] for k, (_, e) in zip(kids, under, strict=True)) / sums[0] if kids else own
        return (1, own) if own <= below + 1e-12 else (1 + sum(n for n, _ in under), below)

    for m in (0.0, 2.0, 20.0, 1e9):
        assert tree.pruned(m).size() == plain(0, m)[0] <= tree.size()
    assert 1 < tree.pruned(2.0).size() < tree.size()
    before = {r.id: r.prediction for r in tree.transform(df.na.drop(subset=["x", "f"])).collect()}
    merged = tree.merged()
    after = {r.id: r.prediction for r in merged.transform(df.na.drop(subset=["x", "f"])).collect()}
    rows = df.where("x is not null and f is not null and not isnan(z)").select("id").collect()
    assert merged.size() <= tree.size() and all(before[r.id] == after[r.id] for r in rows)
    # A split that tells nothing is cut back, one that tells all stays.
    hand = DecisionTree(["x"], [], "y", classes=["a", "b"])
    from tarnwork.operators.trees import Node

    hand.nodes = [Node([10.0, 6.0, 4.0], 0, 1.5, [1, 2]), Node([5.0, 3.0, 2.0]), Node([5.0, 3.0, 2.0])]
    assert hand.pruned(2).size() == 1 and hand.merged().size() == 1 and hand.size() == 3
    hand.nodes[1].sums, hand.nodes[2].sums = [6.0, 6.0, 0.0], [4.0, 0.0, 4.0]
    # root: 1 - (6 + 1.2) / 12; left 1 - (6 + 1.2) / 8, right 1 - (4 + 0.8) / 6: 0.4 against 0.14
    assert hand.pruned(2).size() == 3 and hand.merged().size() == 3
    numbers = DecisionTree(["x", "z"], ["f"], "v", "variance", depth=6, min_rows=1).fit(df)
    assert numbers.pruned(5.0).size() == plain(0, 5.0, numbers)[0] < numbers.size()
    with pytest.raises(ValueError):
        numbers.merged()


def test_tree_edges(spark):
    df = spark.createDataFrame(mixed(), SCHEMA)
    for measure, target in (("gini", "y"), ("variance", "v")):
        empty = DecisionTree(["x"], ["f"], target, measure).fit(df.limit(0))
        assert {r.prediction for r in empty.transform(df).collect()} == {None} and empty.dump()
        lone = DecisionTree([], [], target, measure).fit(df)
        assert lone.size() == 1 and len({r.prediction for r in lone.transform(df).collect()}) == 1
    void = df.withColumns({"x": F.lit(None).cast("double"), "f": F.lit(None).cast("string")})
    assert DecisionTree(["x"], ["f"], "y").fit(void).size() == 1
    odd = spark.createDataFrame([(float("inf"), "a", 'q"\\'), (1.0, "b", "q'"), (float("-inf"), "b", "é,")] * 4, "x double, y string, f string")
    tree = DecisionTree(["x"], [], "y", "info_gain").fit(odd)
    assert tree.transform(odd).where("prediction <> y").count() == 0
    tree = DecisionTree([], ["f"], "y", "info_gain", depth=1).fit(odd)
    assert tree.transform(odd).where("prediction <> y").count() == 0 and tree.transform(odd.withColumn("f", F.lit("new"))).first().prediction == "b"
    assert tree.transform(odd.limit(0)).columns == ["x", "y", "f", "prediction", "probability"]


def test_tree_queries(spark):
    from tarnwork.plans import learners

    t = learners.l7_pruned_tree(spark, SF)
    assert t.where("prediction = three").count() > 0.8 * t.count()
    r = learners.l7_regression_tree(spark, SF).agg(F.avg((F.col("z") - F.col("prediction")) ** 2).alias("e"), F.var_pop("z").alias("v"), F.count("*").alias("n")).first()
    assert r.e < 0.35 * r.v and r.n == t.count()


def test_rows_are_dealt_to_all_cores(spark, monkeypatch):
    """Levels pass over the rows of a table in one file with all cores."""
    seen, own = [], DecisionTree._descended
    monkeypatch.setattr(DecisionTree, "_descended", lambda tree, df, *more: (seen.append(df.rdd.getNumPartitions()), own(tree, df, *more))[1])
    df = spark.range(0, 200, 1, 1).selectExpr("cast(id as double) as x", "cast(id > 90 as string) as y")
    tree = DecisionTree(["x"], [], "y", depth=2).fit(df)
    assert tree.transform(df).where("prediction = y").count() == 200
    assert len(seen) >= 2 and min(seen) == spark.sparkContext.defaultParallelism
