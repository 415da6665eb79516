"""Anchors that separate classes: energy and slope against sums over all pairs, descent, planted classes, signal to noise."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.operators import anchors as A

NAMES, SCHEMA = ["a", "b", "c", "d"], "id int, a double, b double, c double, d double, y string, v double"


def rows(n=300, seed=1):
    """Three classes, each higher in a column of its own; the fourth column is noise."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        k = i % 3
        p = rng.uniform(0, 1, 4) + [*(2.0 * np.eye(3)[k]), 0]
        out.append((i, *map(float, p), "pqr"[k], float(p[0] - 2 * p[1])))
    return out


def scaled(data):
    x = np.array([r[1:5] for r in data])
    return (x - x.min(0)) / (x.max(0) - x.min(0))


def direct(data, anchors, law, numeric, normalize, width, cells, attract=1.0, repel=1.0, sigma=1.0):
    """The softened law summed over all pairs."""
    z = scaled(data)
    anchors = np.array(anchors)
    at = z @ anchors / ((z @ np.hypot(*anchors.T))[:, None] if normalize else 1)
    r2 = ((at[:, None] - at[None]) ** 2).sum(2)
    near, apart = A.pair_energy(law, r2, 4 * width / cells, sigma)
    if numeric:
        v = np.array([r[6] for r in data])
        v = (v - v.mean()) / v.std()
        e = repel * apart * (v[:, None] - v[None]) ** 2
    else:
        y = np.array([r[5] for r in data])
        e = np.where(y[:, None] == y[None], attract * near, repel * apart)
    return e.sum() / 2 / len(data) ** 2


def state(m, df, anchors):
    prepared, channels = m._prepared(df)
    n = prepared.count()
    width = 1.0 if m.normalize else prepared.agg(F.max(sum(F.col(f"v{i}") for i in range(len(m.names))))).first()[0]
    placed = m._placed(prepared, anchors, width)
    dealt = m._dealt(placed, channels)
    energy, fields = m._fields(dealt, n, width)
    return energy, width, lambda: m._slope(placed, fields, anchors, dealt, n, width)


@pytest.mark.parametrize(("law", "numeric", "normalize"), [("linear", False, True), ("square", False, True), ("gaussian", False, False), ("nearest", False, True), ("linear_plus", False, True), ("linear", True, True), ("square", True, False)])
def test_equals_direct_sum(spark, law, numeric, normalize):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    m = A.FreeViz(NAMES, "v" if numeric else "y", law, numeric, normalize=normalize)
    anchors = np.array([(1, 0.1), (-0.4, 0.8), (-0.3, -0.6), (0.2, -0.5)])
    energy, width, slope = state(m, df, anchors)
    sums = lambda at: direct(data, at, law, numeric, normalize, width, m.cells)
    parts = [abs(direct(data, anchors, law, numeric, normalize, width, m.cells, *w)) for w in ((1, 0), (0, 1))]
    assert abs(energy - sums(anchors)) <= 0.01 * sum(parts)
    g = slope()
    h, want = 0.01, np.zeros((4, 2))
    for i in range(4):
        for j in range(2):
            by = np.zeros((4, 2))
            by[i, j] = h
            want[i, j] = (sums(anchors + by) - sums(anchors - by)) / (2 * h)
    assert np.abs(g - want).max() <= 0.05 * np.abs(want).max()


@pytest.mark.parametrize("restrain", ["", "circle", "radius"])
def test_descends_and_separates(spark, restrain):
    data = rows(240)
    df = spark.createDataFrame(data, SCHEMA)
    m = A.FreeViz(NAMES, "y", restrain=restrain, steps=15).fit(df)
    assert len(m.energies) > 1 and all(b < a for a, b in zip(m.energies, m.energies[1:], strict=False))
    lengths = np.hypot(*np.array(m.anchors).T)
    assert abs(lengths.max() - 1) < 1e-9 and abs(m.anchors[0][1]) < 1e-9 and m.anchors[1][1] >= -1e-9
    if restrain == "circle":
        assert np.allclose(lengths, 1)
    if restrain == "radius":
        angles = np.arctan2(*np.array(m.anchors).T[::-1])
        assert all(l < 1e-9 or abs((a - i * math.pi / 2 + math.pi) % (2 * math.pi) - math.pi) < 1e-6 for i, (a, l) in enumerate(zip(angles, lengths, strict=True)))
    at = {r.id: (r.px, r.py) for r in m.projected(df).collect()}
    start = A.FreeViz(NAMES, "y", steps=0).fit(df)
    before = {r.id: (r.px, r.py) for r in start.projected(df).collect()}

    def apart(points):
        p = np.array([points[r[0]] for r in data])
        centres = np.array([p[k::3].mean(0) for k in range(3)])
        inner = np.mean([((p[k::3] - centres[k]) ** 2).sum(1).mean() for k in range(3)])
        return ((centres[:, None] - centres[None]) ** 2).sum(2).mean() / inner

    assert apart(at) > apart(before)
    if not restrain:
        assert lengths[3] < 0.5  # the column of noise goes to the middle
        p = m.classifier(df).transform(df)
        assert p.where("prediction = y").count() > 0.95 * len(data)


def test_rows_in_parts_and_repeated_give_the_same(spark):
    df = spark.createDataFrame(rows(90), SCHEMA)
    a, b = (A.FreeViz(NAMES, "y", steps=4).fit(t).anchors for t in (df.coalesce(1), df.union(df).repartition(5)))
    assert np.allclose(a, b, atol=1e-6)


def test_edges(spark):
    df = spark.createDataFrame(rows(30), SCHEMA)
    even = A.FreeViz(NAMES, "y", steps=2).fit(df.limit(0))
    assert np.allclose(even.anchors, [(1, 0), (0, 1), (-1, 0), (0, -1)]) and not even.energies and even.projected(df.limit(0)).count() == 0
    gaps = df.withColumns({"a": F.when(F.col("id") % 4 > 0, F.col("a")), "b": F.when(F.col("id") % 5 > 0, F.col("b")).otherwise(float("nan")), "y": F.when(F.col("id") % 7 > 0, F.col("y"))})
    known = gaps.where("a is not null and not isnan(b) and y is not null")
    assert np.allclose(A.FreeViz(NAMES, "y", steps=3).fit(gaps).anchors, A.FreeViz(NAMES, "y", steps=3).fit(known).anchors)
    assert A.FreeViz(NAMES, "y", steps=3).fit(gaps).projected(gaps).where("px is null").count() == 0
    same = df.withColumns({c: F.lit(1.0) for c in NAMES})
    assert np.isfinite(A.FreeViz(NAMES, "y", steps=3).fit(same).anchors).all()
    one = df.withColumn("y", F.lit("p"))
    assert np.isfinite(A.FreeViz(NAMES, "y", steps=3).fit(one).anchors).all()
    assert A.FreeViz(["a"], "y", steps=3).fit(df).anchors == [(1.0, 0.0)]
    with pytest.raises(ValueError):
        A.FreeViz(NAMES, "y", law="cubic").fit(df)


def test_signal_to_noise(spark):
    data = rows(60)
    df = spark.createDataFrame(data, SCHEMA).withColumn("a", F.when(F.col("id") != 5, F.col("a")))
    x = np.array([[np.nan if (j == 0 and r[0] == 5) else r[1 + j] for j in range(4)] for r in data])
    y = np.array([r[5] for r in data])
    m, s = (np.array([f(x[y == c], 0) for c in "pqr"]) for f in (np.nanmean, np.nanstd))
    want = {n: sum(abs(m[i, j] - m[k, j]) / (s[i, j] + s[k, j]) for i in range(3) for k in range(i)) for j, n in enumerate(NAMES)}
    got = {r.attribute: r.s2n for r in A.signal_to_noise(df, NAMES, "y").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[c], want[c], rel_tol=1e-9) for c in got)
    each = {(r.attribute, r["class"]): r.s2n for r in A.signal_by_class(df, NAMES, "y").collect()}
    for j, n in enumerate(NAMES):
        for k, c in enumerate("pqr"):
            v = abs(m[k, j] - np.nanmean(x[y != c, j])) / (s[k, j] + np.nanstd(x[y != c, j]))
            assert math.isclose(each[n, c], v if m[k, j] == m[:, j].max() else -v, rel_tol=1e-9)
    places = A.noise_anchors(df, NAMES, "y")
    assert set(places) == set(NAMES)
    angle = {c: math.atan2(*places[c][::-1]) % (2 * math.pi) for c in places}
    assert abs(places["a"][1]) < 1e-9 and np.allclose([angle[c] for c in "bc"], [2 * math.pi / 3, 4 * math.pi / 3])  # each class has its own column in the middle
    assert A.noise_anchors(df.limit(0), NAMES, "y") == {} and A.signal_to_noise(df.limit(0), NAMES, "y").count() == 0


def test_queries(spark):
    """Over whole tables: energies fall, and the rows that train have their class most often."""
    from tarnwork.plans import learners

    sf = "/root/testdata/sf0.001"
    p = learners.l30_freeviz_classes(spark, sf)
    assert p.where("prediction is null").count() == 0 and p.where("prediction = three").count() > 0.6 * p.count()
    for q, table in (("l30_freeviz", "lineitem"), ("l30_noise_anchors", "lineitem"), ("l30_freeviz_values", "part")):
        out = getattr(learners, q)(spark, sf)
        assert out.count() == spark.read.parquet(f"{sf}/{table}.parquet").count() and out.where("px * px + py * py > 9.01 or px is null").count() == 0
