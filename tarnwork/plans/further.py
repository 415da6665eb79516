"""Composed learners, experiments, matrices, projections and the remaining sources over the test tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork import schema as S
from tarnwork.operators import aggregate as A
from tarnwork.operators import associate as N
from tarnwork.operators import compose as K
from tarnwork.operators import distance as D
from tarnwork.operators import evaluate as E
from tarnwork.operators import learn as L
from tarnwork.operators import matrix as M
from tarnwork.operators import multilabel as B
from tarnwork.operators import projection as J
from tarnwork.operators import sampling as R
from tarnwork.operators import transform as X
from tarnwork.operators.sampling import folds
from tarnwork.plans.mining import _P, _nb, _NB, _NN, predictions
from tarnwork.plans.registry import query, sql_normal, sql_uniform, table  # noqa: F401
from tarnwork.plans.relations import LI_SQL, lineitem
from tarnwork.plans.sources import _path
from tarnwork.plans.statistics import rounded
from tarnwork.sources import readers, writers

# -- matrices -------------------------------------------------------------------------------------

_X = "(select n_nationkey as k, n_regionkey as g, (n_nationkey * 7 % 13)::double as x from nation)"
_M = f"m as (select a.k as i, b.k as j, abs(a.x - b.x) / (select max(x) - min(x) from {_X}) as d from {_X} a join {_X} b on a.k > b.k), u as (select i, j, d from m union all select j, i, d from m)"


def _nations(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("g"), (F.col("n_nationkey") * 7 % 13).cast("double").alias("x"))


def _matrix(s: SparkSession, d: str) -> DataFrame:
    return D.distance_matrix(_nations(s, d), "k", ["x"], "manhattan")


@query(f"with {_M} select i, j, round(d, 9) as d, cast(rank as integer) as rank from (select *, row_number() over (partition by i order by d, j) as rank from u) where rank <= 4")
def n9_nearest(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.nearest(_matrix(s, d), 4), 9, "d")


@query(f"with {_M} select i, j, round((select max(d) from m) - d, 9) as d from m")
def n9_inverted(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.inverted(_matrix(s, d), "max-x"), 9, "d")


@query(f"with {_M} select i, j, round(1 / (1 + exp(-(1 - d))), 9) as d from m")
def n9_normalized(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.normalized(M.inverted(_matrix(s, d)), "sigmoid"), 9, "d")


@query(f"with {_M}, z as (select *, (d - (select min(d) from m)) / (select max(d) - min(d) from m) as e from m) select i, j, round(greatest(d, e), 9) as d from z")
def n9_combined(s: SparkSession, d: str) -> DataFrame:
    m = _matrix(s, d)
    return rounded(M.combined(m, M.normalized(m), "max"), 9, "d")


@query(f"with {_M} select i, j, round(d, 9) as d from m where i % 2 = 0 and j % 2 = 0")
def n9_of_elements(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.of_elements(_matrix(s, d), _nations(s, d).where("k % 2 = 0").select(F.col("k").alias("id"))), 9, "d")


@query(f"with {_M} select a.g as a, b.g as b, round(avg(d), 9) as d from u join {_X} a on a.k = i join {_X} b on b.k = j where a.g > b.g group by 1, 2")
def n9_average_link(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.average_link(_matrix(s, d), _nations(s, d).select(F.col("k").alias("id"), F.col("g").alias("group"))), 9, "d")


@query(f"with {_M}, o as (select k, row_number() over (order by x, k) - 1 as p from {_X}) select a.p // 4 as y, b.p // 4 as x, round(avg(d), 9) as d from u join o a on a.k = i join o b on b.k = j group by 1, 2")
def n10_distance_map(s: SparkSession, d: str) -> DataFrame:
    from tarnwork.operators.relational import numbered

    places = numbered(_nations(s, d), ["x", "k"], "place").select(F.col("k").alias("id"), "place")
    return rounded(M.distance_map(_matrix(s, d), places, 4), 9, "d")


@query("with e as (select vec_id, embedding::double[] as e from embeddings) select vec_id, round(list_sum([((e[i] - e[i - 1]) + (e[i + 1] - e[i - 1]) / 2) / 2 * i for i in range(2, len(e))]), 5) as weighted, len(e) - 2 as n from e")
def n5_derivative(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "embeddings").select("vec_id", D.derivative(F.col("embedding")).alias("e"))
    return t.select("vec_id", F.round(F.aggregate(F.transform("e", lambda x, i: x * (i + 2)), F.lit(0.0), lambda a, b: a + b), 5).alias("weighted"), F.size("e").cast("long").alias("n"))


# -- transformers, samples, schemas ---------------------------------------------------------------------


@query(f"with f as (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer) select c_custkey, round((c_acctbal - lo) / (hi - lo) + 0.1 * ({sql_uniform(4, 'c_custkey')} - 0.5), 8) as c_acctbal from customer, f")
def t29_jittered(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "customer").select("c_custkey", "c_acctbal")
    return rounded(X.jittered(X.normalize(t, ["c_acctbal"], by="span"), ["c_acctbal"], ["c_custkey"], 0.1, 4), 8, "c_acctbal")


@query("""with f as (select avg(o_totalprice) as a, stddev_pop(o_totalprice) as s from orders) select o_orderkey, round((o_totalprice - a) / s, 7) as o_totalprice, (o_orderstatus = 'F')::int::double as "o_orderstatus=F", (o_orderstatus = 'O')::int::double as "o_orderstatus=O", (o_orderstatus = 'P')::int::double as "o_orderstatus=P" from orders, f""")
def t14_continuize(s: SparkSession, d: str) -> DataFrame:
    t = S.with_roles(table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), metas=["o_orderkey"], discrete={"o_orderstatus": ["F", "O", "P"]})
    return rounded(X.continuize(t), 7, "o_totalprice")


@query("with f as (select (o_totalprice > 100000)::int + (o_totalprice > 200000)::int as a, (o_custkey > 500)::int as b from orders) select a::integer as \"D_o_totalprice\", b::integer as \"D_o_custkey\", count(*) as n from f group by 1, 2")
def t8_discretize_each(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "orders").select("o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    return X.discretize_each(t, {"o_totalprice": [100000.0, 200000.0], "o_custkey": [500.0]}).groupBy("D_o_totalprice", "D_o_custkey").agg(F.count("*").alias("n"))


@query(f"with l as (select * from {LI_SQL}) select l_orderkey, l_partkey, coalesce(tax, (select max(tax) from l)) as tax, coalesce(flag, 'none') as flag, coalesce(ln, (select min(ln) from l)) as ln from l")
def t21_impute_table(s: SparkSession, d: str) -> DataFrame:
    return X.impute_table(lineitem(s, d).select("l_orderkey", "l_partkey", "tax", "flag", "ln"), {"tax": "maximal", "flag": ("default", "none"), "ln": "minimal"})


@query("select customer.c_custkey from customer order by md5('6|' || c_custkey::varchar), c_custkey limit (select cast(floor(count(*) * 0.5 + 0.5) as bigint) from customer)")
def r9_select_half(s: SparkSession, d: str) -> DataFrame:
    return R.subset_two(table(s, d, "customer").select("c_custkey"), 0.5, ["c_custkey"], 6).where("subset = 0").drop("subset")


@query("select * from part order by md5('8|' || p_partkey::varchar), p_partkey limit 1")
def u8_random_row(s: SparkSession, d: str) -> DataFrame:
    return R.random_row(table(s, d, "part"), ["p_partkey"], 8)


@query("select 'toxic' as class, toxic::varchar as value, count(*) as n from labels group by toxic union all select 'quality', quality::varchar, count(*) from labels group by quality")
def p5_pick_class(s: SparkSession, d: str) -> DataFrame:
    """The distribution of the class, whichever of two is picked."""
    t = S.with_roles(table(s, d, "labels").withColumns({c: F.col(c).cast("string") for c in ("quality", "toxic")}), class_var="quality", metas=["doc_id"], discrete={"quality": ["0", "1"], "toxic": ["0", "1"]})
    t = S.convert(t, S.Domain(tuple(S.Variable(v.name, v.kind, "multiclass" if v.kind == "discrete" else v.role, v.values) for v in S.domain_of(t).variables)))
    picked = [S.domain_of(S.pick_class(t, c)).class_var.name for c in ("toxic", "quality")]
    return reduce(DataFrame.unionByName, (t.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("class"), "value", "n") for c in picked))


@query("select o_orderkey::double as k, case when o_orderstatus in ('F', 'O', 'P') then o_orderstatus end as status, null::double as size from orders union all select null, case when p_size > 25 then 'O' else 'X' end, p_size from part")
def j6_merged_domain(s: SparkSession, d: str) -> DataFrame:
    """Rows of two tables in the domain that both have a part in."""
    a = S.with_roles(table(s, d, "orders").select(F.col("o_orderkey").cast("double").alias("k"), F.col("o_orderstatus").alias("status")), discrete={"status": ["F", "O", "P"]})
    b = S.with_roles(table(s, d, "part").select(F.when(F.col("p_size") > 25, "O").otherwise("X").alias("status"), F.col("p_size").cast("double").alias("size")), discrete={"status": ["O", "X"]})
    both = S.domain_of(a).merged(S.domain_of(b))
    return S.convert(a, both).unionByName(S.convert(b, both))


@query("select r_regionkey::double as k, r_name as name from region")
def s14_rows(s: SparkSession, d: str) -> DataFrame:
    rows = [[float(r[0]), r[1]] for r in table(s, d, "region").collect()]  # five rows
    return readers.from_rows(s, rows, S.Domain((S.Variable("k"), S.Variable("name", "string", "meta"))))


@query("select 'p_size' as attribute, count(p_size) as known, 0::bigint as unknown, min(p_size)::double as low, max(p_size)::double as high, round(avg(p_size), 6) as mean from part union all select 'p_retailprice', count(p_retailprice), 0, min(p_retailprice), max(p_retailprice), round(avg(p_retailprice), 6) from part")
def a35_summary(s: SparkSession, d: str) -> DataFrame:
    return rounded(A.summary(table(s, d, "part"), ["p_size", "p_retailprice"]), 6, "mean")


@query("with c as (select l_returnflag as \"outer\", l_linestatus as \"inner\", count(*) as n from lineitem group by 1, 2), t as (select \"outer\", sum(n) as t from c group by 1), p as (select l_linestatus as \"inner\", count(*) / (select count(*) from lineitem) as p from lineitem group by 1) select \"outer\", \"inner\", round((n + 2 * p) / (t + 2), 9) as p from c join t using (\"outer\") join p using (\"inner\")")
def a32_conditional_estimates(s: SparkSession, d: str) -> DataFrame:
    return rounded(A.conditional_estimates(table(s, d, "lineitem"), "l_returnflag", "l_linestatus", 2.0), 9, "p")


@query(" union all ".join(f"select '{'+'.join(x)}' as members, count(distinct ({', '.join(x)})) as n from part" for x in (("p_brand", "p_size"), ("p_brand", "p_type"), ("p_size", "p_type"), ("p_brand", "p_size", "p_type"))))
def t32_subsets(s: SparkSession, d: str) -> DataFrame:
    """How many different rows each subset of columns has."""
    t = table(s, d, "part")
    return reduce(DataFrame.unionByName, (t.agg(F.count_distinct(*x).alias("n")).select(F.lit("+".join(x)).alias("members"), "n") for x in K.subsets(["p_brand", "p_size", "p_type"], 2, 3)))


# -- learners and experiments --------------------------------------------------------------------------------


def _folded(s: SparkSession, d: str) -> DataFrame:
    return folds(_nb(s, d), 3, ["k"], 1)


_FOLD = f"(select *, cast((row_number() over (order by md5('1|' || k::varchar), k) - 1) % 3 as integer) as fold from {_NB})"


@query(f"with t as {_FOLD}, q as (select f.fold, y, sum(n) as n from (select distinct fold from t) f join (select fold as other, y, count(*) as n from t group by 1, 2) c on other <> f.fold group by 1, 2), b as (select fold, arg_max(y, n) as best from q group by 1) select k as row, t.fold, 'majority' as learner, y as actual, best as predicted from t join b using (fold) union all select k, fold, 'size', y, case when b::int >= 3 then 'y' else 'n' end from t")
def e3_experiment(s: SparkSession, d: str) -> DataFrame:
    size = lambda train: lambda rows: rows.withColumn("prediction", F.when(F.col("b").cast("int") >= 3, "y").otherwise("n"))
    return K.experiment(_folded(s, d), {"majority": K.majority("y"), "size": size}, "fold", 3, "k", "y")


@query(f"with t as {_NB}, r as (select i, k, y, row_number() over (partition by i order by md5(concat_ws('|', 5 + i, k)), k) - 1 as r, count(*) over (partition by i) as n from t, (select unnest([0, 1, 2]) as i)), p as (select *, r < floor(n * 0.7 + 0.5) as train from r), c as (select i, y, count(*) as n from p where train group by 1, 2), b as (select i, arg_max(y, n) as best from c group by 1) select k as row, i::integer as fold, 'majority' as learner, y as actual, best as predicted from p join b using (i) where not train")
def e2_proportion_test(s: SparkSession, d: str) -> DataFrame:
    return K.proportion_test(_nb(s, d), {"majority": K.majority("y")}, "k", "y", 0.7, 3, 5)


@query("select n_nationkey as row, n_regionkey::varchar as actual, (select g from (select n_regionkey::varchar as g, count(*) as n from nation b where b.n_nationkey <> a.n_nationkey group by 1) order by n desc, g limit 1) as predicted from nation a")
def e1_leave_one_out(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("g"))
    return K.leave_one_out(t, {"majority": K.majority("g")}, "n_nationkey", "g").select("row", "actual", "predicted")


@query(f"with t as {_NB}, c as (select y, count(*) as n from t group by 1) select k, a, b, y, (select y from c order by n desc, y limit 1) as majority, case when k % 2 = 0 then 'y' else 'n' end as parity from t")
def e13_predictions(s: SparkSession, d: str) -> DataFrame:
    t = _nb(s, d)
    return K.with_predictions(t, {"majority": K.majority("y")(t), "parity": lambda rows: rows.withColumn("prediction", F.when(F.col("k") % 2 == 0, "y").otherwise("n"))})


@query(f"with t as {_NB}, p as (select count(*) filter (where y = 'n') / count(*) as n from t) select k, case when {sql_uniform(9, 'k')} < n then 'n' else 'y' end as prediction from t, p")
def l1_random(s: SparkSession, d: str) -> DataFrame:
    t = _nb(s, d)
    return K.random_class("y", ["k"], 9)(t)(t).select("k", "prediction")


@query(f"with t as {_P}, c as (select p, count(*) filter (where actual = '1') as a, count(*) filter (where actual = '0') as b from t group by 1), r as (select p as threshold, (sum(a) over (order by p desc) + sum(b) over () - sum(b) over (order by p desc)) / (sum(a) over () + sum(b) over ()) as ca from c) select threshold, round(ca, 9) as ca from r")
def l21_cutoffs(s: SparkSession, d: str) -> DataFrame:
    return rounded(K.cutoffs(predictions(s, d)), 9, "ca")


@query("select p_partkey, round(regr_intercept(p_retailprice, p_size) over () + regr_slope(p_retailprice, p_size) over () * p_size, 5) as p_retailprice_predicted, round(regr_intercept(p_partkey, p_size) over () + regr_slope(p_partkey, p_size) over () * p_size, 5) as key_predicted from part")
def l24_targets(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "part").withColumn("key", F.col("p_partkey").cast("double"))
    fit = lambda y: lambda train: L.LinearRegression(["p_size"], y).fit(train).transform
    out = K.targets({"p_retailprice": fit("p_retailprice"), "key": fit("key")})(t)(t)
    return rounded(out.select("p_partkey", "p_retailprice_predicted", "key_predicted"), 5, "p_retailprice_predicted", "key_predicted")


@query(f"{_NN}, v as (select probe, avg((label % 2)::double) as odd, avg((label > 4)::int::double) as high from n join e on vec_id = neighbour where rank <= 7 group by 1) select probe, round(odd, 9) as odd, round(high, 9) as high, (odd >= 0.5)::int as odd_predicted, (high >= 0.5)::int as high_predicted from v")
def l23_br_knn(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "embeddings").withColumns({"odd": F.col("label") % 2, "high": (F.col("label") > 4).cast("int")})
    return rounded(B.br_knn(D.nearest_vectors(t.where("vec_id % 20 = 0"), t, "vec_id", "embedding", 7), t, "vec_id", ["odd", "high"]), 9, "odd", "high")


@query("select 'p_size' as feature, round(regr_slope(p_retailprice, p_size), 7) as p_retailprice, round(regr_slope(p_partkey, p_size), 7) as key from part")
def l16_pls(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "part").withColumn("key", F.col("p_partkey").cast("double"))
    b = L.pls(t, ["p_size"], ["p_retailprice", "key"], 1)
    return rounded(s.createDataFrame([("p_size", *map(float, b[0]))], "feature string, p_retailprice double, key double"), 7, "p_retailprice", "key")


@query("with c as (select c_mktsegment as a, c_nationkey as b, count(*)::double as n from customer group by 1, 2), x as (select sum(coalesce(n, 0) * coalesce(n, 0) / (r.n_ * k.n_)) - 1 as phi from (select a, sum(n) as n_ from c group by 1) r cross join (select b, sum(n) as n_ from c group by 1) k left join c using (a, b)) select round(phi, 9) as inertia from x")
def l31_inertia(s: SparkSession, d: str) -> DataFrame:
    _, _, inertia = J.correspondence_table(table(s, d, "customer"), "c_mktsegment", "c_nationkey")
    return rounded(s.createDataFrame([(float(sum(inertia)),)], "inertia double"), 9, "inertia")


@query("select o_orderkey, case when o_orderstatus = 'F' then 'class=old' else 'class=new' end as prediction from orders")
def n16_rule_classifier(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.array(F.concat(F.lit("status="), "o_orderstatus")).alias("items"))
    rules = s.createDataFrame([("status=F", "class=old", 0.9), ("status=O", "class=new", 0.8), ("status=F", "class=new", 0.2), ("status=P", "class=new", 0.7)], "left string, right string, confidence double")
    return N.classify(t, rules, "class=").select(F.col("key").alias("o_orderkey"), "prediction")


@query(f"with t as {_P} select sum((a.p > b.p)::int)::double as c, sum((a.p < b.p)::int)::double as d, sum((a.p = b.p)::int)::double as t from t a join t b on a.actual = '1' and b.actual = '0'")
def e9_concordance(s: SparkSession, d: str) -> DataFrame:
    return E.concordance(predictions(s, d))


@query(f"""with t as (select actual, p, n_chars / 5000.0::double as q from {_P} join (select doc_id as row, n_chars from documents) using (row)), n as (select count(*) filter (where actual = '1')::double as np, count(*) filter (where actual = '0')::double as nn from t),
  u as (select sum((a.p > b.p)::int + (a.p = b.p)::int * 0.5::double) / count(*) as a0, sum((a.q > b.q)::int + (a.q = b.q)::int * 0.5::double) / count(*) as a1 from t a join t b on a.actual = '1' and b.actual = '0'),
  v as (select a0, a1, (a0 * (1 - a0) + (np - 1) * (a0 / (2 - a0) - a0 * a0) + (nn - 1) * (2 * a0 * a0 / (1 + a0) - a0 * a0)) / (np * nn) as v0, (a1 * (1 - a1) + (np - 1) * (a1 / (2 - a1) - a1 * a1) + (nn - 1) * (2 * a1 * a1 / (1 + a1) - a1 * a1)) / (np * nn) as v1 from u, n)
  select round(a0, 9) as first, round(a1, 9) as second, round(a0 - a1, 9) as difference, round(sqrt(v0 + v1), 9) as se, round((a0 - a1) / sqrt(v0 + v1), 7) as z from v""")
def e9_compare_aucs(s: SparkSession, d: str) -> DataFrame:
    t = predictions(s, d).join(table(s, d, "documents").select(F.col("doc_id").alias("row"), (F.col("n_chars") / 5000).alias("q")), "row")
    return rounded(rounded(E.compare_aucs(t, "p", "q"), 9, "first", "second", "difference", "se"), 7, "z")


@query("select p_partkey, case when p_size > 25 then 'large' else 'small' end as prediction from part")
def t31_from_column(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "part").select("p_partkey", "p_size")
    return K.from_column(F.when(F.col("p_size") > 25, "large").otherwise("small"))(t)(t).select("p_partkey", "prediction")


def _late(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select((F.col("o_totalprice") / 100000).alias("price"), (F.col("o_custkey") / 1000).alias("customer"), (F.pmod(F.col("o_orderkey"), F.lit(7)) / 7 + F.col("o_totalprice") / 400000 > 0.9).cast("double").alias("y"))


@query()
def l4_statistics(s: SparkSession, d: str) -> DataFrame:
    m = L.Logistic(["price", "customer"], "y").fit(_late(s, d))
    rows = zip(["(constant)", *m.names], *(map(float, x) for x in (m.coefficients, m.statistics["se"], m.statistics["z"], m.statistics["p"])), strict=True)
    return s.createDataFrame(list(rows), "attribute string, beta double, se double, wald_z double, p double")


@query("select 'price' as attribute")
def l4_stepwise(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(c,) for c in L.stepwise_logistic(_late(s, d), ["price", "customer"], "y", 0.01, 0.05)], "attribute string")


@query()
def l29_fisher(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "part").withColumn("y", (F.col("p_size") >= 25).cast("string"))
    return L.fisher(t, ["p_size", "p_retailprice"], "y", 1)[1].select("p_partkey", "y", "fd1")


# -- sources ------------------------------------------------------------------------------------------------------


@query("select n_nationkey::double as n_nationkey, n_regionkey::double as n_regionkey from nation")
def s13_k8_numpy(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "nation").select("n_nationkey", "n_regionkey")
    return readers.from_numpy(s, writers.to_numpy(t, t.columns), t.columns)


@query("select r_regionkey, r_name from region")
def k10_saved_table(s: SparkSession, d: str) -> DataFrame:
    path = _path(s, "r.parquet")
    t = S.with_roles(table(s, d, "region"), class_var="r_name", discrete={"r_name": ["AFRICA"]})
    writers.write(t, path)
    back = readers.read(s, path)
    if S.domain_of(back).class_var.values != ("AFRICA",):
        raise ValueError("the domain was lost")
    return back


@query("select c_mktsegment, count(*) as n from customer group by 1")
def k7_catalog_table(s: SparkSession, d: str) -> DataFrame:
    import uuid

    name = f"tarnwork_{uuid.uuid4().hex}"
    writers.write_table(table(s, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")), name, path=_path(s, "t"))
    return readers.read_sql(s, None, f"select c_mktsegment, n from {name}", discrete=["c_mktsegment"])


def _text(s: SparkSession, name: str, lines: list[str]) -> str:
    path = _path(s, name)
    s.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


@query("select n_name, n_regionkey::double as n_regionkey, case when n_regionkey = 0 then '1' else '0' end as low, case when n_nationkey % 2 = 1 then '1' else '0' end as odd from nation")
def s9_mulan(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "nation").select("n_name", F.col("n_regionkey").cast("double").alias("n_regionkey"), F.when(F.col("n_regionkey") == 0, "1").otherwise("0").alias("low"), (F.col("n_nationkey") % 2).cast("string").alias("odd"))
    path = _path(s, "n.arff")
    writers.write(S.with_roles(t, metas=["n_name"], discrete={"low": ["0", "1"], "odd": ["0", "1"]}), path)
    xml = _text(s, "n.xml", ["<labels>", '<label name="low"></label>', '<label name="odd"></label>', "</labels>"])
    return readers.read_mulan(s, path, xml)


@query("select n_regionkey::double as r, count(*)::double as n from nation group by 1")
def s12_sql_file(s: SparkSession, d: str) -> DataFrame:
    table(s, d, "nation").createOrReplaceTempView("tarnwork_nation")
    return readers.read_sql_file(s, _text(s, "q.sql", ["class: n", "discrete:", "select cast(n_regionkey as double) as r, cast(count(*) as double) as n", "from tarnwork_nation group by 1"])).select("r", "n")


@query("select n_nationkey::bigint as src, ((n_nationkey + 1) % 25)::bigint as dst, n_regionkey::double as weight, 'net' as form from nation union all select n_nationkey, (n_nationkey + 1) % 25, n_regionkey::double, 'gml' from nation")
def s20_networks(s: SparkSession, d: str) -> DataFrame:
    rows = [(r[0], (r[0] + 1) % 25, r[1]) for r in table(s, d, "nation").select("n_nationkey", "n_regionkey").collect()]  # 25 nations
    net = _text(s, "n.net", ["*Vertices 25", *(f'{k} "v{k}"' for k in range(25)), "*Arcs", *(f"{a} {b} {w}" for a, b, w in rows)])
    gml = _text(s, "n.gml", ["graph [", *(f"node [ id {k} ]" for k in range(25)), *(f"edge [ source {a} target {b} value {w} ]" for a, b, w in rows), "]"])
    parts = [readers.read_pajek(s, net)[1], readers.read_gml(s, gml)[1]]
    return parts[0].select("src", "dst", "weight", F.lit("net").alias("form")).unionByName(parts[1].select("src", "dst", "weight", F.lit("gml").alias("form")))


@query("select n_name, n_regionkey from nation")
def s15_registered_format(s: SparkSession, d: str) -> DataFrame:
    readers.register(".nat", lambda spark, path: spark.read.parquet(path))
    path = _path(s, "x.nat")
    table(s, d, "nation").select("n_name", "n_regionkey").write.parquet(path)
    return readers.read(s, path)


def _image(n: int) -> np.ndarray:
    """Places of a map's nodes."""
    return np.array([(x, y) for x in range(n) for y in range(n)], float)


@query()
def l33_som(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return J.som(t, "v", _image(3), 10, 1).assign(t).groupBy("node").agg(F.count("*").alias("n"))


@query()
def l32_mds(s: SparkSession, d: str) -> DataFrame:
    rows = [(r["i"], r["j"], r["d"]) for r in _matrix(s, d).collect()]  # of 25 nations
    m = np.zeros((25, 25))
    for i, j, x in rows:
        m[i, j] = m[j, i] = x
    return s.createDataFrame([(k, *map(float, p)) for k, p in enumerate(J.smacof(m, L.torgerson(m, 2)))], "id long, x double, y double")


@query()
def l20_stacking(s: SparkSession, d: str) -> DataFrame:
    t = _folded(s, d).withColumn("label", (F.col("y") == "y").cast("double"))
    base = {"pa": K.naive_bayes(["a"], "y"), "pb": K.naive_bayes(["b"], "y")}
    top = lambda names: L.ml("logistic", names, "label", maxIter=20)
    return K.stacking(base, top, "fold", 3)(t)(t).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query()
def l21_tuned(s: SparkSession, d: str) -> DataFrame:
    _, scores = K.tune(_folded(s, d), lambda m: K.naive_bayes(["a", "b"], "y", m), [0.0, 2.0, 50.0], "fold", 3, "y")
    return s.createDataFrame([(float(m), float(a)) for m, a in scores], "m double, ca double")


@query("select 'b' as column_name")
def l22_stepwise(s: SparkSession, d: str) -> DataFrame:
    t = _folded(s, d).withColumn("c", (F.col("k") % 3).cast("string"))
    found = K.stepwise(t, ["a", "b", "c"], lambda names: K.naive_bayes(names, "y"), "fold", 3, "y")
    return s.createDataFrame([(c,) for c in found], "column_name string")


@query()
def m16_m17_model_scores(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "part").withColumn("y", (F.col("p_size") >= 25).cast("double")).withColumn("none", F.pmod(F.xxhash64("p_partkey"), F.lit(50)).cast("double"))
    names = ["p_size", "p_retailprice", "none"]
    kept = K.eliminate(t, names, lambda df, c: K.linear_weights(df, c, "y", maxIter=20), 1)
    forest = K.forest_weights(t, names, "y", numTrees=10, seed=1)
    return s.createDataFrame([(c, float(forest[c]), c in kept) for c in names], "attribute string, forest double, kept boolean")
