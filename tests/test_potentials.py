"""Potentials of projected rows against the direct sum over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.operators import potentials as P

NAMES, SCHEMA = ["a", "b", "c"], "id int, a double, b double, c double, y string, v double"


def rows(n=400, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        k = int(rng.integers(3))
        p = np.round(rng.normal(0, 0.25 if i % 4 else 0.001, 3) + np.eye(3)[k], 4)
        out.append([i, *map(float, p), None if i % 19 == 0 else "pqr"[k], float(np.round(p @ [1, -2, 0.5], 3))])
    out[7][1] = None
    out[8][2] = float("nan")
    return [tuple(r) for r in out]


def direct(data, law, numeric, normalize):
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in data])
    train = np.array([numeric or r[4] is not None for r in data])
    low, high, mean = np.nanmin(x[train], 0), np.nanmax(x[train], 0), np.nanmean(x[train], 0)
    z = (np.where(np.isnan(x), mean, x) - low) / (high - low)
    anchors = np.array(P.radial_anchors(NAMES))
    at = z @ anchors
    if normalize:
        total = z @ np.hypot(*anchors.T)
        at = at / np.where(total > 0, total, 1)[:, None]
    r2 = ((at[:, None] - at[train][None]) ** 2).sum(2)
    safe = np.maximum(r2, 1e-8)
    f = {"inverse": np.where(r2 < 1e-8, 1e4, safe**-0.5), "square": np.where(r2 < 1e-8, 1e8, 1 / safe), "exponential": np.where((r2 < 1e-8) & numeric, 1e4, np.exp(-np.sqrt(r2)))}[law]
    if numeric:
        v = np.array([r[5] for r in data])[train]
        return (f @ v) / f.sum(1)
    y = np.array([[r[4] == c for c in "pqr"] for r in data], float)[train]
    p = f @ y
    return p / p.sum(1, keepdims=True)


@pytest.mark.parametrize(("law", "numeric", "normalize", "error"), [("inverse", False, True, 0.02), ("square", False, False, 0.05), ("exponential", False, True, 0.02), ("inverse", False, True, 0.0), ("inverse", True, False, 0.02), ("exponential", True, True, 0.0)])
def test_equals_direct_sum(spark, law, numeric, normalize, error):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    m = P.Potentials(NAMES, "v" if numeric else "y", law=law, numeric=numeric, normalize=normalize, error=error, few=4).fit(df)
    got = {r.id: r for r in m.transform(df).collect()}
    want = direct(data, law, numeric, normalize)
    assert len(got) == len(data)
    for i, w in enumerate(want):
        if numeric:  # of a mean both sums err
            assert abs(got[i].prediction - w) <= (2 * error * max(abs(r[5]) for r in data) if error else 1e-8)
        else:
            assert np.allclose(got[i].probability, w, atol=1e-9, rtol=2.1 * error)


def test_far_squares_replace_pairs(spark):
    """Twice the rows take far less than four times the evaluations."""
    done = []
    for n in (400, 1600):
        df = spark.createDataFrame(rows(n), SCHEMA)
        m = P.Potentials(NAMES, "y", error=0.05, few=4).fit(df)
        calls = []
        own = m._sums
        m._sums = lambda pairs, points, own=own, calls=calls: (calls.append(pairs.count()), own(pairs, points))[1]
        m.transform(df).count()
        done.append(sum(calls) / n**2)
    assert done[1] < 0.6 * done[0]


def test_no_pairs_through_the_driver(spark):
    """Nothing is broadcast to evaluate potentials."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame(rows(2000), SCHEMA)
        m = P.Potentials(NAMES, "y", law="square").fit(df)
        found = m.potentials(m.project(df).select(F.col("_px").alias("tx"), F.col("_py").alias("ty")))
        assert "Broadcast" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bounds_hold():
    """The bound on the law against the worst of random squares."""
    rng = np.random.default_rng(0)
    laws = {"inverse": lambda r: 1 / r, "square": lambda r: r**-2, "exponential": lambda r: np.exp(-r)}
    for law, f in laws.items():
        for h in (0.5, 0.1, 0.01):
            k = P.farthest_apart(law, 0.02, h)
            if k is None:
                continue
            for _ in range(300):
                p = rng.integers(0, 2, (rng.integers(1, 6), 2)) * h if rng.random() < 0.5 else rng.uniform(0, h, (5, 2))
                t = np.array([k * h + rng.uniform(0, h), rng.uniform(0, k + 1) * h])
                far, one = f(np.hypot(*(t - p).T)).sum(), len(p) * f(np.hypot(*(t - p.mean(0))))
                assert abs(one - far) <= 0.02 * far
    assert P.farthest_apart("exponential", 0.02, 10.0) is None


def test_edges(spark):
    df = spark.createDataFrame(rows(30), SCHEMA)
    none = P.Potentials(NAMES, "y").fit(df.limit(0))
    assert {r.prediction for r in none.transform(df).collect()} == {None}
    assert {r.prediction for r in P.Potentials(NAMES, "v", numeric=True).fit(df.limit(0)).transform(df).collect()} == {None}
    m = P.Potentials(NAMES, "y").fit(df)
    assert m.transform(df.limit(0)).count() == 0
    same = df.withColumns({c: F.lit(1.0) for c in NAMES})
    out = P.Potentials(NAMES, "y").fit(same).transform(same.union(same)).collect()
    assert len(out) == 60 and len({r.prediction for r in out}) == 1
    void = df.withColumns({c: F.lit(None).cast("double") for c in NAMES})
    assert P.Potentials(NAMES, "y").fit(void).transform(void).count() == 30
    with pytest.raises(ValueError):
        P.Potentials(NAMES, "y", law="cubic").fit(df)


def test_queries(spark):
    """Against the direct sum over the whole table: what differs by more than the bound is none."""
    from tarnwork.plans import learners

    sf = "/root/testdata/sf0.001"
    t = learners._gaps(spark, sf)
    names = ["size", "p_retailprice", "p_partkey"]
    got = {r.p_partkey: r.prediction for r in learners.l6_potential_means(spark, sf).collect()}
    exact = {r.p_partkey: r.prediction for r in P.Potentials(names, "z", numeric=True, normalize=False, error=0.0).fit(t).transform(t).collect()}
    most = max(abs(r.z) for r in t.collect())
    assert got.keys() == exact.keys() and all(abs(got[k] - exact[k]) <= 0.04 * most for k in got)
    p = learners.l6_potentials(spark, sf)
    assert p.where("prediction is null").count() == 0 and p.where("prediction = three").count() > 0.6 * p.count()
