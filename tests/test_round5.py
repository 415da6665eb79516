"""Findings of the fourth report: machines by landmarks, files and pairs of large tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.operators import kernel as K


@pytest.mark.parametrize(("kind", "target", "options"), [("nu_svr", "v", {"nu": 0.3}), ("c_svc", "y", {"c": 10.0, "weights": (1.0, 2.0)})])
def test_landmarks_instead_of_support(spark, monkeypatch, kind, target, options):
    """With far more rows of weight than are held, the machine of landmarks meets the conditions that the plain solver's meets."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 10, (300, 2)) / 10
    v = np.sin(3 * x[:, 0]) - x[:, 1] ** 2 + rng.integers(0, 100, 300) / 200
    y = np.where((x[:, 0] - 0.5) ** 2 + (x[:, 1] - 0.5) ** 2 + rng.normal(0, 0.05, 300) < 0.1, 1.0, -1.0)
    df = spark.createDataFrame([(*map(float, p), float(a), float(b)) for p, a, b in zip(x, v, y, strict=True)], "a double, b double, v double, y double")
    make = lambda **more: K.Machine(["a", "b"], kind, K.Kernel(gamma=2.0), **options, **more)
    plain = make().fit(df, target)
    monkeypatch.setattr(K, "MOST_HELD", 10, raising=False)
    monkeypatch.setattr(K, "FIRST", 20, raising=False)
    few = make(max_support=55).fit(df, target)
    assert len(few.support) <= 55 < len(plain.support)
    assert few.width == pytest.approx(plain.width, abs=2e-3) or kind == "c_svc"
    assert df.agg(F.max(F.abs(few.decision() - plain.decision()))).first()[0] < 0.02


def test_distance_rows_in_several_files(spark, tmp_path, monkeypatch):
    """Rows are written in runs, none is shuffled as a line, and files are read back in their order, in splits that end inside them; unknown distances too."""
    from tarnwork.sources import readers, writers

    monkeypatch.setattr(writers, "CELLS_IN_A_FILE", 2000, raising=False)
    monkeypatch.setattr(readers, "numbered", lambda *a, **k: pytest.fail("lines are sorted"), raising=False)
    x = [None if k % 17 == 3 else (k * 37 % 101) / 4 for k in range(400)]
    t = spark.createDataFrame([(k, f"r{k}", v) for k, v in enumerate(x)], "i long, label string, x double")
    path, every = str(tmp_path / "m.dst"), spark.createDataFrame([(x,)], "every array<double>")
    writers.write_distance_rows(t.repartition(5), path, 400, F.transform(F.slice("every", F.lit(1), F.col("i").cast("int")), lambda v: F.abs(F.col("x") - v)), every)
    assert len(list((tmp_path / "m.dst").glob("part-*"))) > 20
    for size in ("128m", "5k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert {(r.i, r.label) for r in readers.read_distance_labels(spark, path).collect()} == {(k, f"r{k}") for k in range(400)}
            got = {(r.i, r.j): r.d for r in readers.read_distance_matrix(spark, path).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == {(a, b): None if x[a] is None or x[b] is None else abs(x[a] - x[b]) for a in range(400) for b in range(a)}


def test_clustering_of_near_values(spark):
    """As of the links themselves, with equal, negative, unknown, infinite and lone values, and differences that are rounded to `reach`."""
    from tarnwork.operators import graph as G

    rng = np.random.default_rng(2)
    x = [*(rng.integers(-300, 300, 150) / 10), 0.1, 0.4, 0.7, 0.30000000000000004, 1e3, -0.0, 0.0, None, float("nan"), float("inf"), float("inf")]
    t = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(x)], "id long, x double")
    for reach in (0.3, 2.0, 17.5):
        edges = t.alias("a").join(t.alias("b"), (F.col("a.id") > F.col("b.id")) & (F.abs(F.col("a.x") - F.col("b.x")) <= reach)).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))
        want = {r.id: round(r.coefficient, 12) for r in G.clustering(edges).collect()}
        assert {r.id: round(r.coefficient, 12) for r in G.near_clustering(t, "id", "x", reach).collect()} == want and len(want) > 50


@pytest.mark.parametrize("regression", [False, True])
def test_relief_ranks_few_pairs(spark, monkeypatch, regression):
    """Neighbours by trying all pairs, ties and unknown values with them; what leaves the tasks to be ranked is a small part of these."""
    from tarnwork.operators import scoring as S

    rng = np.random.default_rng(4)
    n, m, k = 4000, 12, 5
    a = [None if v < 0.1 else round(float(v), 2) for v in rng.random(n)]
    f = [None if v == 0 else "pqrs"[v % 4] for v in rng.integers(0, 9, n)]
    y = [float(v) for v in rng.random(n)] if regression else ["no" if v else "yes" for v in rng.integers(0, 3, n)]
    t = spark.createDataFrame(list(zip(range(n), a, f, y, strict=True)), f"k long, a double, f string, y {'double' if regression else 'string'}").repartition(3)
    passed, plain = [], S._candidates
    monkeypatch.setattr(S, "_candidates", lambda *o: passed.append(plain(*o)) or passed[-1])
    got = {(r.ref, r.key) for r in S.relief_neighbours(t, ["a"], ["f"], "y", "k", m, k, regression).pairs.collect()}
    assert passed[0].count() < n * m / 5
    known, share = [v for v in a if v is not None], {c: f.count(c) / sum(v is not None for v in f) for c in "pqrs"}
    mean, span = sum(known) / len(known), max(known) - min(known)

    def apart(p, q):
        d = 0.5 if a[p] is None and a[q] is None else abs((mean if a[p] is None else a[p]) - (mean if a[q] is None else a[q])) / span
        both = 1 - sum(s * s for s in share.values())
        return round(d + (both if f[p] is None and f[q] is None else 1 - share[f[q] or f[p]] if f[p] is None or f[q] is None else float(f[p] != f[q])), 12)

    want = set()
    for ref in {r for r, _ in got}:
        every = [(apart(ref, q), q) for q in range(n) if q != ref]
        for own in [every] if regression else [[e for e in every if y[e[1]] == c] for c in ("no", "yes")]:
            own = [e for e in own if e[0] > 0]
            reach = sorted(own)[k - 1][0]
            want |= {(ref, q) for d, q in own if d <= reach}
    assert len({r for r, _ in got}) == m and got == want


def test_pairs_in_tiles(spark, monkeypatch):
    """Whatever the tiles, blocks of other sizes, unknown values and keys, keys that repeat; rows of a tile come row by row, so that files hold them in little."""
    from tarnwork.operators import distance as D

    monkeypatch.setattr(D, "IN_A_TILE", 7, raising=False)
    rng = np.random.default_rng(5)
    data = [(int(k), int(b) if b else None, float(x) if x > 5 else None, int(y)) for k, b, x, y in zip([*range(90), 3, 3, 40], rng.integers(0, 4, 93) ** 2, rng.integers(0, 50, 93), rng.integers(0, 3, 93), strict=True)] + [(None, 1, 1.0, 1)]
    df = spark.createDataFrame(data, "k int, b int, x double, y int").repartition(3)
    span = max(r[2] for r in data if r[2]) - min(r[2] for r in data if r[2])
    want = sorted((p[0], q[0], round(max(0.5 if p[2] is None or q[2] is None else abs(p[2] - q[2]) / span, abs(p[3] - q[3]) / 2), 6)) for p in data[:93] for q in data[:93] if p[0] > q[0] and p[1] == q[1] is not None)
    got = D.distance_matrix(df, "k", ["x", "y"], "maximal", "b", 6)
    assert sorted((r.i, r.j, round(r.d, 6)) for r in got.collect()) == want and got.dtypes == [("i", "int"), ("j", "int"), ("d", "double")]
    got = D.distance_matrix(df.withColumn("b", F.lit(1)), "k", ["x"], block="b")
    runs = got.mapInPandas(lambda parts: ((t.assign(n=int((t["i"].diff().fillna(1) != 0).sum()))[["n"]].head(1)) for t in parts), "n long")
    assert runs.agg(F.sum("n")).first()[0] < got.count() / 3


def test_vectors_are_sent_as_they_are(spark):
    """Each vector goes to as many tasks as there are blocks, so single precision is not widened before."""
    from tarnwork.operators import distance as D

    df = spark.createDataFrame([(k, [float(k % 3), k / 7, 1.0]) for k in range(120)], "k long, v array<float>")
    found = D.all_pairs(df, "k", "v", D.pearson_of, 6)
    assert "array<double>" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 7140
