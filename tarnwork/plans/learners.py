"""Queries of kernel machines, clustering trees, rule induction with corrected qualities, local regression and related learners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators.anchors import FreeViz, noise_anchors, signal_by_class, signal_to_noise
from tarnwork.operators.clustertree import ClusteringTree
from tarnwork.operators.decompose import construct, im_scores, redundant
from tarnwork.operators.graph import pathfinder
from tarnwork.operators.kernel import SVM, Kernel
from tarnwork.operators.local import LoessBayes, curve_points, loess_curve, loess_rows
from tarnwork.operators.potentials import Potentials
from tarnwork.operators.projection import Components
from tarnwork.operators.relational import spread
from tarnwork.operators.rules import RuleLearner
from tarnwork.operators.trees import DecisionTree
from tarnwork.plans.registry import query, table


def _parts(s: SparkSession, d: str) -> DataFrame:
    """Parts with a class, a value and three classes that bend."""
    t = table(s, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    a, b = (F.col("p_size") - 25) / 25, (F.col("p_retailprice") - 950) / 50
    return t.withColumns({"y": F.when(a * a + b * b < 0.5, "in").otherwise("out"), "z": a * a - b + F.col("p_partkey") * 7919 % 101 / 500, "three": F.when(a + b < -0.5, "low").when(a * b > 0.2, "same").otherwise("rest")})


def _machine(s: SparkSession, d: str, target: str | None, kind: str, kernel: Kernel, **options: float) -> DataFrame:
    t = _parts(s, d)
    return SVM(["p_size", "p_retailprice"], target, kind, kernel, options=options).fit(t).transform(t)


@query()
def l12_rbf(s: SparkSession, d: str) -> DataFrame:
    return _machine(s, d, "y", "c_svc", Kernel(gamma=4.0), c=10.0).select("p_partkey", "y", "prediction")


@query()
def l12_nu(s: SparkSession, d: str) -> DataFrame:
    return _machine(s, d, "y", "nu_svc", Kernel("polynomial", 1.0, 2, 1.0), nu=0.05).select("p_partkey", "y", "prediction")


@query()
def l12_several_classes(s: SparkSession, d: str) -> DataFrame:
    return _machine(s, d, "three", "c_svc", Kernel(gamma=4.0), c=10.0).select("p_partkey", "three", "prediction")


@query()
def l12_one_class(s: SparkSession, d: str) -> DataFrame:
    return _machine(s, d, None, "one_class", Kernel(gamma=4.0), nu=0.05).select("p_partkey", "prediction")


@query()
def l12_regression(s: SparkSession, d: str) -> DataFrame:
    return _machine(s, d, "z", "epsilon_svr", Kernel(gamma=2.0), c=10.0, epsilon=0.1).select("p_partkey", "z", F.round("prediction", 6).alias("prediction"))


@query()
def l12_nu_regression(s: SparkSession, d: str) -> DataFrame:
    return _machine(s, d, "z", "nu_svr", Kernel(gamma=2.0), nu=0.05).select("p_partkey", "z", F.round("prediction", 6).alias("prediction"))


@query()
def l9_clustering_tree(s: SparkSession, d: str) -> DataFrame:
    t = _parts(s, d)
    tree = ClusteringTree(["p_size", "p_partkey"], ["p_brand"], ["p_retailprice", "z"], depth=4, min_rows=10).fit(t)
    return tree.transform(t).select("p_partkey", "leaf", F.round("prediction_p_retailprice", 6).alias("price"), F.round("prediction_z", 6).alias("z"))


@query()
def l9_label_tree(s: SparkSession, d: str) -> DataFrame:
    t = _parts(s, d)
    tree = ClusteringTree(["p_size", "p_retailprice"], ["p_brand"], labels=["y", "three"], measure="gini", depth=4, min_rows=10).fit(t)
    return tree.transform(t).select("p_partkey", "y", "three", "prediction_y", "prediction_three")


def _binned(s: SparkSession, d: str) -> DataFrame:
    t = _parts(s, d)
    return t.select("p_partkey", "y", "three", "p_brand", F.floor(F.col("p_size") / 10).cast("string").alias("size"), F.floor((F.col("p_retailprice") - 900) / 10).cast("string").alias("price"))


def _ruled(s: SparkSession, d: str, target: str, **options: str | float) -> DataFrame:
    t = _binned(s, d)
    return RuleLearner(["p_brand", "size", "price"], target, **options).fit(t).transform(t).select("p_partkey", target, "prediction")


@query()
def l10_ordered(s: SparkSession, d: str) -> DataFrame:
    return _ruled(s, d, "three", covering="ordered", beam=3, length=2, least_covered=5, alpha=0.001)


@query()
def l10_weighted(s: SparkSession, d: str) -> DataFrame:
    return _ruled(s, d, "y", covering="weighted", measure="wracc", beam=3, length=2, factor=0.01)


@query()
def l10_corrected(s: SparkSession, d: str) -> DataFrame:
    return _ruled(s, d, "y", covering="probable", measure="evc", simulations=20, beam=3, length=2, least_improved=20)


@query()
def a32_loess_curve(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem")
    at = curve_points(t, "l_quantity", 20)
    found = loess_curve(t, "l_quantity", [(F.col("l_returnflag") == v).cast("double") for v in "ANR"], at, 0.3)
    return s.createDataFrame([(p, *map(float, row)) for p, row in zip(at, found, strict=True)], "x double, a double, n double, r double")


@query()
def c10_loess_rows(s: SparkSession, d: str) -> DataFrame:
    return loess_rows(table(s, d, "lineitem"), "l_extendedprice", "l_quantity", 50)


@query()
def l3_loess_bayes(s: SparkSession, d: str) -> DataFrame:
    t = _parts(s, d)
    return LoessBayes(["p_size", "p_retailprice"], "three", 0.2).fit(t).transform(t).select("p_partkey", "three", "prediction")


def _decomposed(s: SparkSession, d: str) -> DataFrame:
    t = _binned(s, d)
    return t.withColumns({"half": (F.col("size").cast("int") >= 3).cast("string"), "odd": (F.col("p_partkey") % 2).cast("string"), "c": F.when((F.col("size").cast("int") >= 3) == (F.col("price").cast("int") % 2 == 0), "same").otherwise("other")})


@query("""with t as (select p_size // 10 as size, floor((p_retailprice - 900) / 10)::int as price, p_partkey % 2 as odd from part), u as (select *, case when (size >= 3) = (price % 2 = 0) then 'same' else 'other' end as c from t), p as (select c, count(*) / sum(count(*)) over () as p from u group by 1),
  x as (select size, price, odd, p.c, p.p, count(u.c) as n from (select distinct size, price, odd from u) k cross join p left join u using (size, price, odd, c) group by all), e as (select size, price, odd, sum(n) * (1 - max(n + 2 * p) / (sum(n) + 2)) as e, sum(n) as n from x group by 1, 2, 3)
  select a as attribute, round(-sum(e) / sum(n), 8) as quality from e, (select unnest(['size', 'price', 'odd']) as a) group by 1""")
def m15_incompatibility(s: SparkSession, d: str) -> DataFrame:
    found = im_scores(_decomposed(s, d), ["size", "price", "odd"], "c")
    return s.createDataFrame([(c, round(q, 8)) for c, q in found.items()], "attribute string, quality double")


@query()
def t34_merged_feature(s: SparkSession, d: str) -> DataFrame:
    t = _decomposed(s, d)
    return construct(t, ["size", "odd"], ["price"], "c").transform(t, "made").groupBy("size", "odd", "made").agg(F.count("*").alias("n"))


@query()
def p18_redundant(s: SparkSession, d: str) -> DataFrame:
    t = _decomposed(s, d)
    left, _ = redundant(t, ["size", "price", "odd"], "c")
    return t.select("p_partkey", "c", *left)


@query("""with e as (select a.s_suppkey as src, b.s_suppkey as dst, round(abs(a.s_acctbal - b.s_acctbal) % 97, 4) as weight from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey), u as (select src, dst, weight from e union all select dst, src, weight from e)
  select src, dst, weight from e where not exists (select 1 from u x join u y on x.dst = y.src where x.src = e.src and y.dst = e.dst and x.weight < e.weight and y.weight < e.weight)""")
def n19_pathfinder(s: SparkSession, d: str) -> DataFrame:
    t = spread(table(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"))
    a, b = t.alias("a"), t.alias("b")
    edges = a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey")))
    edges = edges.select(F.col("a.s_suppkey").alias("src"), F.col("b.s_suppkey").alias("dst"), F.round(F.abs(F.col("a.s_acctbal") - F.col("b.s_acctbal")) % 97, 4).alias("weight"))
    return pathfinder(edges, 2)


@query()
def l29_components(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem")
    return Components(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], covered=0.9).fit(t).transform(t).select("l_orderkey", "l_linenumber", "pc1", "pc2")


@query()
def l29_supervised(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem")
    return Components(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], most=2, class_name="l_returnflag").fit(t).transform(t).select("l_orderkey", "l_linenumber", "pc1", "pc2")


def _gaps(s: SparkSession, d: str) -> DataFrame:
    """Parts with values that are unknown."""
    return _parts(s, d).withColumns({"size": F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")), "brand": F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand"))})


@query()
def l7_pruned_tree(s: SparkSession, d: str) -> DataFrame:
    t = _gaps(s, d)
    tree = DecisionTree(["size", "p_retailprice"], ["brand"], "three", depth=4, min_rows=5).fit(t).pruned(2.0)
    return tree.transform(t).select("p_partkey", "three", "prediction")


@query()
def l7_regression_tree(s: SparkSession, d: str) -> DataFrame:
    t = _gaps(s, d)
    tree = DecisionTree(["size", "p_retailprice"], ["brand"], "z", "variance", "subset", depth=4, min_rows=5).fit(t)
    return tree.transform(t).select("p_partkey", "z", F.round("prediction", 6).alias("prediction"))


@query("""with t as (select p_partkey, p_size as x, p_retailprice as y from part), v as (select x, count(*) as n, sum(y) as s from t group by 1), l as (select x, lead(x) over (order by x) as above, sum(n) over w as n, sum(s) over w as s from v window w as (order by x)),
  a as (select count(*) as n, sum(y) as s from t), b as (select (x + above) / 2.0 as cut, l.s / l.n as low, (a.s - l.s) / (a.n - l.n) as high from l, a where above is not null and l.n >= 10 and a.n - l.n >= 10 order by round(l.s * l.s / l.n + (a.s - l.s) * (a.s - l.s) / (a.n - l.n), 4) desc, x limit 1)
  select p_partkey, round(case when x <= cut then low else high end, 6) as prediction from t, b""")
def l7_best_cut(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "part")
    tree = DecisionTree(["p_size"], [], "p_retailprice", "variance", depth=1, min_rows=10).fit(t)
    return tree.transform(t).select("p_partkey", F.round("prediction", 6).alias("prediction"))


@query()
def l6_potentials(s: SparkSession, d: str) -> DataFrame:
    t = _gaps(s, d)
    return Potentials(["size", "p_retailprice", "p_partkey"], "three", law="square").fit(t).transform(t).select("p_partkey", "three", "prediction")


@query()
def l6_potential_means(s: SparkSession, d: str) -> DataFrame:
    t = _gaps(s, d)
    return Potentials(["size", "p_retailprice", "p_partkey"], "z", numeric=True, normalize=False).fit(t).transform(t).select("p_partkey", "z", F.round("prediction", 6).alias("prediction"))


_FLAGGED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query()
def l30_freeviz(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem").withColumn("day", F.datediff("l_shipdate", F.lit("1992-01-01")))
    m = FreeViz([*_FLAGGED, "day"], "l_returnflag", steps=20).fit(t)
    return m.projected(t).select("l_orderkey", "l_linenumber", "l_returnflag", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


@query()
def l30_freeviz_classes(s: SparkSession, d: str) -> DataFrame:
    t = _gaps(s, d)
    m = FreeViz(["p_size", "p_retailprice", "p_partkey"], "three", steps=20).fit(t)
    return m.classifier(t).transform(t).select("p_partkey", "three", "prediction")


@query()
def l30_freeviz_values(s: SparkSession, d: str) -> DataFrame:
    t = _gaps(s, d)
    m = FreeViz(["p_size", "p_retailprice", "p_partkey"], "z", numeric=True, normalize=False, steps=20).fit(t)
    return m.projected(t).select("p_partkey", "z", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


_MOMENTS = """with u as (unpivot (select l_returnflag as class, l_quantity::double as l_quantity, l_extendedprice::double as l_extendedprice, l_discount::double as l_discount, l_tax::double as l_tax from lineitem)
    on l_quantity, l_extendedprice, l_discount, l_tax into name attribute value x),
  t as (select attribute, class, count(x)::double as n, sum(x) as s, sum(x * x) as q, avg(x) as m, stddev_pop(x) as d from u group by 1, 2)"""


@query(f"""{_MOMENTS} select a.attribute, round(sum(abs(a.m - b.m) / (a.d + b.d)), 9) as s2n from t a join t b on a.attribute = b.attribute and a.class < b.class where a.d + b.d > 0 group by 1""")
def l30_s2n(s: SparkSession, d: str) -> DataFrame:
    return signal_to_noise(table(s, d, "lineitem"), _FLAGGED, "l_returnflag").select("attribute", F.round("s2n", 9).alias("s2n"))


@query(f"""{_MOMENTS}, r as (select a.attribute, a.class, avg(u.x) as m, stddev_pop(u.x) as d from t a join u on a.attribute = u.attribute and a.class <> u.class group by 1, 2), top as (select attribute, max(m) as m from t group by 1)
  select t.attribute, t.class, round(case when t.m < top.m then -1 else 1 end * abs(t.m - r.m) / (t.d + r.d), 9) as s2n from t join r using (attribute, class) join top on t.attribute = top.attribute""")
def l30_s2n_by_class(s: SparkSession, d: str) -> DataFrame:
    return signal_by_class(table(s, d, "lineitem"), _FLAGGED, "l_returnflag").select("attribute", "class", F.round("s2n", 9).alias("s2n"))


@query()
def l30_noise_anchors(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem")
    anchors = noise_anchors(t, _FLAGGED, "l_returnflag")
    m = FreeViz(list(anchors), "l_returnflag", anchors=list(anchors.values()), steps=0).fit(t)
    return m.projected(t).select("l_orderkey", "l_linenumber", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))
