"""Aggregates, distributions, contingency, transformers, scores and statistics over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions import stats as C
from tarnwork.operators import aggregate as A
from tarnwork.operators import sampling as R
from tarnwork.operators import scoring as M
from tarnwork.operators import transform as X
from tarnwork.operators.relational import spread
from tarnwork.plans.registry import query, sql_normal, sql_uniform, table
from tarnwork.plans.relations import LI_SQL, lineitem


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"""select flag, l_linestatus, round(avg(l_quantity), 6) as l_quantity, coalesce(round(sum(tax), 6), 0) as tax, count(*) as ln, min(l_extendedprice) as l_extendedprice, max(l_discount) as l_discount from {LI_SQL} group by 1, 2""")
def a1_group_by(s: SparkSession, d: str) -> DataFrame:
    t = A.group_by(lineitem(s, d), ["flag", "l_linestatus"], {"l_quantity": "mean", "tax": "sum", "ln": "count", "l_extendedprice": "min", "l_discount": "max"}, ["l_orderkey"])
    return rounded(t, 6, "l_quantity", "tax")


@query("select o_custkey, arg_min(o_orderstatus, o_orderkey) as o_orderstatus, arg_max(o_totalprice, o_orderkey) as o_totalprice from orders group by 1")
def a2_first_last(s: SparkSession, d: str) -> DataFrame:
    return A.group_by(table(s, d, "orders"), ["o_custkey"], {"o_orderstatus": "first", "o_totalprice": "last"}, ["o_orderkey"])


@query("""select o_orderstatus, arg_max(o_orderkey, md5('{"o_orderkey":' || o_orderkey::varchar || '}')) as o_orderkey from orders group by 1""")
def a3_random(s: SparkSession, d: str) -> DataFrame:
    return A.group_by(table(s, d, "orders"), ["o_orderstatus"], {"o_orderkey": "random"}, ["o_orderkey"])


@query("select o_orderpriority, o_orderstatus from (select o_orderpriority, o_orderstatus, row_number() over (partition by o_orderpriority order by count(*) desc, o_orderstatus) as r from orders group by 1, 2) where r = 1")
def a4_modus(s: SparkSession, d: str) -> DataFrame:
    return A.group_by(table(s, d, "orders"), ["o_orderpriority"], {"o_orderstatus": "modus"}, ["o_orderkey"])


@query("""select l_returnflag, round(exp(avg(ln(l_quantity))), 6) as l_quantity, round(count(*) / sum(1 / case when l_tax = 0 then 1e-6 else l_tax end), 9) as l_tax, case when bool_or(l_discount = 0) then 0.0::double end as l_discount from lineitem group by 1""")
def a6_a7_means(s: SparkSession, d: str) -> DataFrame:
    t = A.group_by(table(s, d, "lineitem"), ["l_returnflag"], {"l_quantity": "geometric mean", "l_tax": "harmonic mean", "l_discount": "geometric mean"}, ["l_orderkey"])
    return rounded(rounded(t, 6, "l_quantity"), 9, "l_tax")


@query("select n_regionkey, string_agg(n_name, ', ' order by n_nationkey) as n_name from nation group by 1")
def a10_join(s: SparkSession, d: str) -> DataFrame:
    return A.group_by(table(s, d, "nation"), ["n_regionkey"], {"n_name": "join"}, ["n_nationkey"])


@query("select o_orderstatus, round(max(o_totalprice) - min(o_totalprice), 6) as o_totalprice from orders group by 1")
def a11_custom(s: SparkSession, d: str) -> DataFrame:
    return rounded(A.group_by(table(s, d, "orders"), ["o_orderstatus"], {"o_totalprice": lambda x, o: F.max(x) - F.min(x)}, ["o_orderkey"]), 6, "o_totalprice")


@query("""select coalesce(o_orderstatus, '(all)') as row, coalesce(o_orderpriority, '(all)') as col, count(*) as n, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 4) as mean, round(stddev_pop(o_totalprice), 4) as deviation, min(o_totalprice) as low, max(o_totalprice) as high from orders group by cube (o_orderstatus, o_orderpriority)""")
def a13_pivot(s: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(A.pivot_with_margins(table(s, d, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice"), 2, "total"), 4, "mean", "deviation")


@query("select round(sum(l_quantity), 4) as weight, count(*) as n from lineitem")
def a14_weight(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").agg(F.round(F.sum("l_quantity"), 4).alias("weight"), F.count("*").alias("n"))


_W = "l_quantity"


@query(f"""with l as (select l_quantity as w, 'tax' as attribute, tax as x from {LI_SQL} union all select l_quantity, 'l_discount', l_discount from lineitem union all select l_quantity, 'l_extendedprice', l_extendedprice from lineitem),
  g as (select attribute, sum(w) filter (where x is not null) as n, sum(w * x) as s, sum(w * x * x) as q, min(x) as lo, max(x) as hi from l group by 1)
  select attribute, round(n, 4) as n, round(s, 4) as sum, lo as min, hi as max, round(s / n, 6) as avg, round(sqrt(greatest(q / n - (s / n) * (s / n), 0)), 5) as dev from g""")
def a15_basic_statistics(s: SparkSession, d: str) -> DataFrame:
    t = A.basic_statistics(lineitem(s, d), ["tax", "l_discount", "l_extendedprice"], F.col("l_quantity")).drop("sum2")
    return rounded(rounded(rounded(t, 4, "n", "sum"), 6, "avg"), 5, "dev")


@query("""with c as (select 'l_quantity' as attribute, corr(l_quantity, l_extendedprice) as r, count(*) as n from lineitem union all select 'l_tax', corr(l_tax, l_extendedprice), count(*) from lineitem)
  select attribute, round(r, 8) as r, n - 2 as df, round(r * sqrt((n - 2) / (1 - r * r)), 5) as t from c""")
def a16_pearson(s: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(A.pearson_matrix(table(s, d, "lineitem"), ["l_quantity", "l_tax"], "l_extendedprice"), 8, "r"), 5, "t")


@query("""with r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as a, rank() over (order by l_discount) + (count(*) over (partition by l_discount) - 1) / 2.0 as b from lineitem) select round(corr(a, b), 8) as rho from r""")
def a17_spearman(s: SparkSession, d: str) -> DataFrame:
    return rounded(A.spearman(table(s, d, "lineitem"), "l_quantity", "l_discount"), 8, "rho")


@query(f"select v.value, coalesce(weight, 0) as weight from (select * from (values ('A'), ('N'), ('R')) t(value)) v left join (select flag, count(*)::double as weight from {LI_SQL} group by 1) f on f.flag = v.value")
def a18_distribution(s: SparkSession, d: str) -> DataFrame:
    return A.distribution(lineitem(s, d), "flag", ["A", "N", "R"])


@query("select l_quantity as value, count(*)::double as weight from lineitem group by 1")
def a19_continuous_distribution(s: SparkSession, d: str) -> DataFrame:
    return A.distribution(table(s, d, "lineitem"), "l_quantity")


@query("select round(avg(o_totalprice), 4) as average, round(var_pop(o_totalprice), 0) as var, round(stddev_pop(o_totalprice), 4) as dev, round(stddev_samp(o_totalprice) / sqrt(count(*)), 5) as error from orders")
def a20_moments(s: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(rounded(A.moments(table(s, d, "orders"), "o_totalprice"), 4, "average", "dev"), 0, "var"), 5, "error")


@query("""with c as (select l_returnflag, l_extendedprice as x, count(*)::double as w from lineitem group by 1, 2), u as (select *, sum(w) over (partition by l_returnflag order by x) as upto, sum(w) over (partition by l_returnflag) as alls, lead(x) over (partition by l_returnflag order by x) as nx from c)
  select l_returnflag, min(x) as p0, min(case when upto > alls * 0.25 - 1e-9 then case when abs(upto - alls * 0.25) < 1e-9 then (x + coalesce(nx, x)) / 2 else x end end) as p25,
  min(case when upto > alls * 0.5 - 1e-9 then case when abs(upto - alls * 0.5) < 1e-9 then (x + coalesce(nx, x)) / 2 else x end end) as p50, max(x) as p100 from u group by 1""")
def a21_percentile(s: SparkSession, d: str) -> DataFrame:
    return A.percentiles(table(s, d, "lineitem"), "l_extendedprice", [0, 25, 50, 100], ["l_returnflag"])


@query("select l_linenumber as value, count(*) / (select count(*) from lineitem) as p from lineitem group by 1")
def a22_density(s: SparkSession, d: str) -> DataFrame:
    return A.density(table(s, d, "lineitem"), "l_linenumber")


@query("select p_partkey, round(exp(-((p_size - m) / s) * ((p_size - m) / s) / 2) / (s * sqrt(2 * pi())), 9) as pdf from part, (select avg(p_size) as m, stddev_pop(p_size) as s from part)")
def a24_gaussian(s: SparkSession, d: str) -> DataFrame:
    return rounded(A.gaussian(table(s, d, "part").select("p_partkey", "p_size"), "p_size", F.col("p_size")).select("p_partkey", "pdf"), 9, "pdf")


@query(f"select 'flag' as attribute, flag as value, count(*)::double as weight from {LI_SQL} group by 2 union all select 'ln', cast(ln as varchar), count(*) from {LI_SQL} group by 2 union all select 'l_linestatus', l_linestatus, count(*) from lineitem group by 2")
def a25_domain_distributions(s: SparkSession, d: str) -> DataFrame:
    return A.domain_distributions(lineitem(s, d), ["flag", "ln", "l_linestatus"])


@query(f'select flag as "outer", ln as "inner", round(sum(l_quantity), 4) as weight from {LI_SQL} group by 1, 2')
def a27_contingency(s: SparkSession, d: str) -> DataFrame:
    return rounded(A.contingency(lineitem(s, d), "flag", "ln", F.col("l_quantity")), 4, "weight")


@query("select o_orderpriority as \"outer\", o_orderstatus as \"inner\", count(*)::double as weight, round(count(*) / sum(count(*)) over (partition by o_orderpriority), 9) as p from orders group by 1, 2")
def a28_conditional(s: SparkSession, d: str) -> DataFrame:
    return rounded(A.conditional(A.contingency(table(s, d, "orders"), "o_orderpriority", "o_orderstatus"), ["outer"]), 9, "p")


@query(f"select 'ln' as attribute, cast(ln as varchar) as value, flag as class, count(*)::double as weight from {LI_SQL} group by 2, 3 union all select 'l_linestatus', l_linestatus, flag, count(*) from {LI_SQL} group by 2, 3")
def a29_domain_contingency(s: SparkSession, d: str) -> DataFrame:
    return A.domain_contingency(lineitem(s, d), ["ln", "l_linestatus"], "flag")


@query("with c as (select o_orderpriority as value, count(*) as n from orders group by 1), w as (select sum(n) as a, count(*) as k from c) select value, round(n / a, 9) as relative, round((n + 1) / (a + k), 9) as laplace, round((n + 2.0::double / k) / (a + 2), 9) as m_estimate from c, w")
def a31_estimates(s: SparkSession, d: str) -> DataFrame:
    return rounded(A.estimates(table(s, d, "orders"), "o_orderpriority"), 9, "relative", "laplace", "m_estimate")


@query("""with t as (select floor(value / 10) as time, count(*) filter (where event_type = 'purchase') as events, count(*) as n from events group by 1),
  r as (select *, sum(n) over (order by time desc) as at_risk from t)
  select cast(time as bigint) as time, cast(at_risk as bigint) as at_risk, events, round(case when max(case when events = at_risk then 1 else 0 end) over (order by time) = 1 then 0 else exp(sum(case when events < at_risk then ln(1 - events / at_risk) end) over (order by time)) end, 9) as survival from r qualify events > 0""")
def a33_kaplan_meier(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "events").withColumn("t", F.floor(F.col("value") / 10))
    return rounded(A.kaplan_meier(t, "t", F.col("event_type") == "purchase"), 9, "survival")


@query("select count(*) as n_rows, 6::bigint as n_columns, 3::bigint as n_continuous, count(distinct o_orderstatus) as n_classes from orders")
def a34_data_info(s: SparkSession, d: str) -> DataFrame:
    return A.data_info(table(s, d, "orders"), "o_orderstatus")


# -- transformers ----------------------------------------------------------------------------------


@query("""with f as (select min(l_extendedprice) as lo, (max(l_extendedprice) - min(l_extendedprice)) / 5 as st from lineitem), c as (select floor((lo + st) * 100 + 0.5) / 100 as first, floor(st * 100 + 0.5) / 100 as step from f)
  select cast(case when l_extendedprice < first then 0 else least(4, floor((l_extendedprice - first) / step) + 1) end as integer) as bin, count(*) as n from lineitem, c group by 1""")
def t1_equal_width(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem")
    first, step = X.equal_width_cuts(t, ["l_extendedprice"], 5)["l_extendedprice"]
    return t.select(X.equal_width(F.col("l_extendedprice"), first, step, 5).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def sql_frequency_cuts(counts: str, n: int) -> str:
    """Equal-frequency cuts (attribute, no, cut) of (attribute, x, w), in a step per cut."""
    return f"""with recursive c as ({counts}), p as (select *, row_number() over (partition by attribute order by x) as r, sum(w) over (partition by attribute order by x) as upto, sum(w) over (partition by attribute) as total,
        lag(x) over (partition by attribute order by x) as px, lead(x) over (partition by attribute order by x) as nx, count(*) over (partition by attribute) as k from c),
      s as (select distinct attribute, 0 as no, null::double as cut, 0.0::double as base, 1::bigint as r, false as stayed from p where k > {n}
        union all select s.attribute, s.no + 1, case when y.stays then (y.x + y.nx) / 2 when s.stayed and y.r = s.r + 1 then y.x else (y.px + y.x) / 2 end, case when y.stays then y.upto else y.upto - y.w end, y.r, y.stays
        from s join (select s.attribute, s.no, min(p.r) as r from s join p on p.attribute = s.attribute and p.r > s.r and p.upto - s.base >= (p.total - s.base) / ({n} - s.no) where s.no < {n} - 1 group by 1, 2) f on f.attribute = s.attribute and f.no = s.no
        join lateral (select p.*, p.nx is not null and p.upto - s.base - (p.total - s.base) / ({n} - s.no) < p.w / 2 as stays from p where p.attribute = s.attribute and p.r = f.r) y on true)
      select attribute, no::integer as no, cut from s where no > 0 union all select attribute, r::integer, (x + nx) / 2 from p where k <= {n} and nx is not null"""


_COUNTS = " union all ".join(f"select '{c}' as attribute, {c} as x, count(*)::double as w from lineitem group by 2" for c in ("l_quantity", "l_discount", "l_extendedprice"))


@query(sql_frequency_cuts(_COUNTS, 4))
def t2_equal_frequency(s: SparkSession, d: str) -> DataFrame:
    return X.cut_rows(X.fit_cuts(table(s, d, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"], "frequency", 4))


@query()
def t3_entropy_cuts(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem").withColumn("y", F.col("l_quantity").between(18, 33).cast("string"))
    return X.cut_rows(X.fit_cuts(t, ["l_quantity", "l_discount"], "entropy", class_name="y"))


@query("""with c as (select l_quantity as x, count(*) filter (where l_quantity between 20 and 30)::double as a, count(*) filter (where l_quantity not between 20 and 30)::double as b from lineitem group by 1),
  p as (select x, row_number() over (order by x) as r, count(*) over () as k, sum(a) over (order by x) as ua, sum(b) over (order by x) as ub, sum(a) over () as ta, sum(b) over () as tb from c),
  q as (select i.x as low, j.x as high, i.r as ir, j.r as jr, j.ua - i.ua as ma, j.ub - i.ub as mb, i.ta, i.tb, (j.ua - i.ua + j.ub - i.ub) / (i.ta + i.tb) as share from p i join p j on i.r < j.r and j.r < j.k),
  best as (select * from q order by (greatest(abs(ma - share * ta) - 0.5, 0) ** 2) / (share * ta) + (greatest(abs(mb - share * tb) - 0.5, 0) ** 2) / (share * tb) desc, ir, jr limit 1)
  select 'l_quantity' as attribute, 1 as no, low as cut from best union all select 'l_quantity', 2, high from best""")
def t4_bimodal_cuts(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem").withColumn("y", F.col("l_quantity").between(20, 30).cast("string"))
    return X.cut_rows(X.fit_cuts(t, ["l_quantity"], "bimodal", class_name="y"))


@query("select cast((l_quantity > 10)::int + (l_quantity > 25)::int + (l_quantity > 40)::int as integer) as bin, count(*) as n from lineitem group by 1")
def t5_t6_fixed_cuts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(X.by_cuts(F.col("l_quantity"), [10, 25, 40]).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query(f"""with cuts as ({sql_frequency_cuts(_COUNTS, 3)}) select cast((select count(*) from cuts where attribute = 'l_quantity' and cut < l_quantity) as integer) as "D_l_quantity", cast((select count(*) from cuts where attribute = 'l_discount' and cut < l_discount) as integer) as "D_l_discount", count(*) as n from lineitem group by 1, 2""")
def t7_discretize_table(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    return X.discretize(t, ["l_quantity", "l_discount"], "frequency", 3).groupBy("D_l_quantity", "D_l_discount").agg(F.count("*").alias("n"))


@query("select l_orderkey, l_partkey, case l_linenumber when 1 then 2 when 2 then 1 when 4 then 0 end as mapped from lineitem")
def t9_map_values(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", X.map_values("l_linenumber", [-1, 2, 1, -1, 0]).alias("mapped"))


@query(f"""select l_orderkey, l_partkey, case when flag is null then null when flag = 'A' then 1.0::double else -1.0::double end as "flag=A", case when flag is null then null when flag = 'R' then 1.0::double else -1.0::double end as "flag=R" from {LI_SQL}""")
def t10_t13_indicators(s: SparkSession, d: str) -> DataFrame:
    return lineitem(s, d).select("l_orderkey", "l_partkey", *X.indicators("flag", ["A", "N", "R"], base="N", zero=-1.0))


@query("select o_orderkey, case o_orderstatus when 'P' then 0.0 when 'O' then 0.5 when 'F' then 1.0 end::double as C_o_orderstatus from orders")
def t11_ordinal(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", X.ordinal("o_orderstatus", ["P", "O", "F"], normalized=True))


@query(f"""with l as (select l_orderkey, l_partkey, l_quantity, tax from {LI_SQL}), f as (select avg(tax) as a, stddev_pop(tax) as s, avg(l_quantity) as qa, stddev_pop(l_quantity) as qs from l)
  select l_orderkey, l_partkey, round((l_quantity - qa) / qs, 7) as l_quantity, coalesce(round((tax - a) / s, 7), 0) as tax from l, f""")
def t12_normalize(s: SparkSession, d: str) -> DataFrame:
    return rounded(X.normalize(lineitem(s, d).select("l_orderkey", "l_partkey", "l_quantity", "tax"), ["l_quantity", "tax"]), 7, "l_quantity", "tax")


@query("with f as (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer) select c_custkey, round((c_acctbal - (lo + hi) / 2) / ((hi - lo) / 2), 9) as c_acctbal from customer, f")
def t13_normalize_span(s: SparkSession, d: str) -> DataFrame:
    return rounded(X.normalize(table(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], by="span", zero_based=False), 9, "c_acctbal")


@query(f"""with l as (select l_orderkey, l_partkey, tax, flag from {LI_SQL}), f as (select median(tax) as m from l), g as (select flag as mf from l where flag is not null group by 1 order by count(*) desc, flag limit 1)
  select l_orderkey, l_partkey, coalesce(tax, m) as tax, coalesce(flag, mf) as flag from l, f, g""")
def t15_impute_average(s: SparkSession, d: str) -> DataFrame:
    return X.impute(lineitem(s, d).select("l_orderkey", "l_partkey", "tax", "flag"), ["tax"], ["flag"])


@query(f"select l_orderkey, l_partkey, coalesce(tax, (select max(tax) from {LI_SQL})) as tax from {LI_SQL}")
def t16_impute_maximal(s: SparkSession, d: str) -> DataFrame:
    return X.impute(lineitem(s, d).select("l_orderkey", "l_partkey", "tax"), ["tax"], [], "maximal")


@query(f"select l_orderkey, l_partkey, coalesce(tax, 0.5::double) as tax, coalesce(flag, 'Z') as flag from {LI_SQL}")
def t17_impute_defaults(s: SparkSession, d: str) -> DataFrame:
    return X.impute_defaults(lineitem(s, d).select("l_orderkey", "l_partkey", "tax", "flag"), {"tax": 0.5, "flag": "Z"})


@query(f"with l as (select l_orderkey, l_partkey, tax, flag from {LI_SQL}), f as (select avg(tax) as m from l) select l_orderkey, l_partkey, round(coalesce(tax, m), 9) as tax, coalesce(flag, 'NA') as flag, case when tax is null then 'undef' else 'def' end as tax_def from l, f")
def t18_impute_as_value(s: SparkSession, d: str) -> DataFrame:
    return rounded(X.impute_as_value(lineitem(s, d).select("l_orderkey", "l_partkey", "tax", "flag"), ["tax"], ["flag"]), 9, "tax")


_ROW = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")  # tells rows apart


@query(f"""with l as (select * from {LI_SQL}), f as (select avg(tax) as m, stddev_pop(tax) as s from l) select l_orderkey, l_partkey, round(coalesce(tax, m + s * {sql_normal(5, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")}), 8) as tax from l, f""")
def t19_impute_random(s: SparkSession, d: str) -> DataFrame:
    t = lineitem(s, d).select(*_ROW[:4], "tax")
    return rounded(X.impute_random(t, ["tax"], _ROW[:4], 5).select("l_orderkey", "l_partkey", "tax"), 8, "tax")


@query(f"""with l as (select l_orderkey, l_partkey, tax, case when l_linenumber % 3 <> 0 then l_quantity end as q, l_extendedprice as e from {LI_SQL}), m as (select avg(q) as q from l), x as (select l.*, coalesce(l.q, m.q) as q0 from l, m),
  f as (select avg(tax) as my, avg(q0) as m1, avg(e) as m2, covar_pop(q0, tax) as c1, covar_pop(e, tax) as c2, var_pop(q0) as v1, var_pop(e) as v2, covar_pop(q0, e) as c from x where tax is not null),
  b as (select *, (c1 * v2 - c2 * c) / (v1 * v2 - c * c) as b1, (c2 * v1 - c1 * c) / (v1 * v2 - c * c) as b2 from f) select l_orderkey, l_partkey, x.q / 1.0 as quantity, round(coalesce(tax, my + b1 * (q0 - m1) + b2 * (e - m2)), 7) as tax from x, b""")
def t20_impute_model(s: SparkSession, d: str) -> DataFrame:
    t = lineitem(s, d).select("l_orderkey", "l_partkey", "tax", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity").cast("double")).alias("quantity"), "l_extendedprice")
    return rounded(X.impute_model(t, "tax", ["quantity", "l_extendedprice"]).select("l_orderkey", "l_partkey", "quantity", "tax"), 7, "tax")


@query("select 150::bigint as missing, 1350::bigint as known where (select count(*) from customer) = 1500 union all select cast(floor(count(*) * 0.1 + 0.5) as bigint), count(*) - cast(floor(count(*) * 0.1 + 0.5) as bigint) from customer having count(*) <> 1500")
def t23_add_missing(s: SparkSession, d: str) -> DataFrame:
    t = X.add_missing(table(s, d, "customer").select("c_custkey", "c_acctbal"), {"c_acctbal": 0.1}, ["c_custkey"], 4)
    return t.agg(F.count_if(F.col("c_acctbal").isNull()).alias("missing"), F.count("c_acctbal").alias("known"))


@query(f"""with r as (select *, row_number() over (order by {sql_uniform(1, 'c_custkey')}, c_custkey) - 1 as r, count(*) over () as n from customer) select c_custkey, case when r < floor(n * 0.2 + 0.5) then case r % 2 when 0 then 'X' else 'Y' end else c_mktsegment end as c_mktsegment from r""")
def t24_add_noise(s: SparkSession, d: str) -> DataFrame:
    return X.add_noise(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", 0.2, ["X", "Y"], ["c_custkey"], 1)


@query(f"select c_custkey, round(c_acctbal + 10 * {sql_normal(2, 'c_custkey')}, 6) as c_acctbal from customer")
def t25_gaussian_noise(s: SparkSession, d: str) -> DataFrame:
    return rounded(X.add_gaussian_noise(table(s, d, "customer").select("c_custkey", "c_acctbal"), {"c_acctbal": 10.0}, ["c_custkey"], 2), 6, "c_acctbal")


@query("with c as (select o_orderstatus, count(*) as n from orders group by 1) select o_orderkey, round((select sum(n) / count(*) from c) / c.n, 9) as weight from orders join c using (o_orderstatus)")
def t26_class_weights(s: SparkSession, d: str) -> DataFrame:
    return rounded(X.class_weights(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus").select("o_orderkey", "weight"), 9, "weight")


@query("select event_id, case when event_type = 'purchase' then 1 else round(value / (select max(value) from events), 9) end as weight from events")
def t27_censor_weights(s: SparkSession, d: str) -> DataFrame:
    return rounded(X.censor_weights_linear(table(s, d, "events").select("event_id", "event_type", "value"), F.col("event_type") == "purchase", "value").select("event_id", "weight"), 9, "weight")


@query("select o_orderkey, case when o_orderstatus = 'F' and o_orderpriority = '1-URGENT' then 3 when o_orderstatus = 'O' and o_orderpriority = '5-LOW' then 1 end as score from orders")
def t30_lookup(s: SparkSession, d: str) -> DataFrame:
    return X.lookup(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"], {("F", "1-URGENT"): 3, ("O", "5-LOW"): 1}, "score").select("o_orderkey", "score")


# -- sampling ----------------------------------------------------------------------------------------


@query("select cast(floor(count(*) * 0.3 + 0.5) as bigint) as n0, count(*) - cast(floor(count(*) * 0.3 + 0.5) as bigint) as n1 from orders")
def r1_subset_two(s: SparkSession, d: str) -> DataFrame:
    return R.subset_two(table(s, d, "orders").select("o_orderkey"), 0.3, ["o_orderkey"], 1).agg(F.count_if(F.col("subset") == 0).alias("n0"), F.count_if(F.col("subset") == 1).alias("n1"))


@query("select o_orderstatus, cast(floor(count(*) * 0.3 + 0.5) as bigint) as n0 from orders group by 1")
def r1_stratified(s: SparkSession, d: str) -> DataFrame:
    return R.subset_two(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), 0.3, ["o_orderkey"], 1, "o_orderstatus").groupBy("o_orderstatus").agg(F.count_if(F.col("subset") == 0).alias("n0"))


@query("with n as (select count(*) as n from customer) select cast(floor(n * 0.2 + 0.5) as bigint) as a, cast(floor(n * 0.5 + 0.5) - floor(n * 0.2 + 0.5) as bigint) as b, cast(n - floor(n * 0.5 + 0.5) as bigint) as c from n")
def r2_subset_many(s: SparkSession, d: str) -> DataFrame:
    return R.subset_many(table(s, d, "customer").select("c_custkey"), [0.2, 0.3], ["c_custkey"]).agg(*(F.count_if(F.col("subset") == k).alias(n) for k, n in enumerate("abc")))


@query("select cast((row_number() over (order by md5('3|' || cast(o_orderkey as varchar)), o_orderkey) - 1) % 5 as integer) as fold, o_orderkey from orders")
def r3_folds(s: SparkSession, d: str) -> DataFrame:
    return R.folds(table(s, d, "orders").select("o_orderkey"), 5, ["o_orderkey"], 3)


@query(f"select c_custkey from (select c_custkey, row_number() over (order by c_custkey) - 1 as no, count(*) over () as n from customer) join (select unnest(range(500)) as id) on no = floor({sql_uniform(2, 'id')} * n)")
def r4_with_replacement(s: SparkSession, d: str) -> DataFrame:
    return R.with_replacement(table(s, d, "customer").select("c_custkey"), 500, ["c_custkey"], 2)


@query("select c_custkey from customer order by md5('0|' || cast(c_custkey as varchar)), c_custkey limit 100")
def r7_sample(s: SparkSession, d: str) -> DataFrame:
    return R.sample(table(s, d, "customer").select("c_custkey"), ["c_custkey"], n=100)


@query(f"""with e as (select replica::integer as replica, c_custkey, {sql_uniform(1, 'replica', 'c_custkey')} as u from customer, (select unnest([0, 1, 2]) as replica)), k as (select *, {' + '.join(f'(u > {x!r}::double)::int' for x in R.poisson_steps())} as k from e) select replica, c_custkey from k, range({len(R.poisson_steps())}) t(i) where i < k""")
def r8_bootstrap(s: SparkSession, d: str) -> DataFrame:
    return R.bootstrap(spread(table(s, d, "customer").select("c_custkey")), ["c_custkey"], 1, 3)


# -- scores -------------------------------------------------------------------------------------------


def _scored(s: SparkSession, d: str) -> DataFrame:
    t = lineitem(s, d)
    return t.select(F.col("ln").cast("string").alias("ln"), "flag", (F.floor(F.col("l_extendedprice") / 20000)).cast("string").alias("price"), (F.col("l_quantity") >= 25).cast("string").alias("y"), "l_extendedprice", "l_quantity")


_SC = f"(select cast(ln as varchar) as ln, flag, cast(cast(floor(l_extendedprice / 20000) as bigint) as varchar) as price, case when l_quantity >= 25 then 'true' else 'false' end as y, l_extendedprice, l_quantity from {LI_SQL})"
_LONG = f"(select 'ln' as attribute, ln as value, y as class from {_SC} union all select 'flag', flag, y from {_SC} union all select 'price', price, y from {_SC})"


_SCORES = f"""with t as (select attribute, value, class, count(*)::double as w from {_LONG} group by 1, 2, 3), a as (select attribute, sum(w) as alls, sum(w) filter (where value is not null) as n from t group by 1),
  k as (select * from t where value is not null), vc as (select attribute, value, sum(w) as v, max(w) as m from k group by 1, 2), cc as (select attribute, class, sum(w) as c from k group by 1, 2),
  j as (select k.attribute, sum(-w / n * log2(w / n)) as hj, sum(w * w / v / n) as gg, sum(w * w / (v * c)) as chi from k join a using (attribute) join vc using (attribute, value) join cc using (attribute, class) group by 1),
  hv as (select attribute, sum(-v / n * log2(v / n)) as hv, sum(m) as mv from vc join a using (attribute) group by 1), hc as (select attribute, sum(-c / n * log2(c / n)) as hc, sum(c * c / (n * n)) as gc, max(c) as mc from cc join a using (attribute) group by 1),
  s as (select attribute, alls, n, hc + hv - hj as gain, hj, hv, gg, gc, mv, mc, chi from a join j using (attribute) join hv using (attribute) join hc using (attribute)),
  r as (select attribute, gain * n / alls as info_gain, gain / hv * n / alls as gain_ratio, (gg - gc) / 2 * n / alls as gini, (mv - mc) / (n - mc) as relevance, gain / hj as distance, n * (chi - 1) as chi_square from s)
  select attribute, round(case when abs(info_gain) < 1e-6 then 0 else info_gain end, 9) as info_gain, round(case when abs(gain_ratio) < 1e-6 then 0 else gain_ratio end, 9) as gain_ratio, round(case when abs(gini) < 1e-6 then 0 else gini end, 9) as gini, round(relevance, 9) as relevance, round(distance, 9) as distance, round(chi_square, 4) as chi_square from r"""


@query(_SCORES)
def m1_m6_scores(s: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(M.score_all(_scored(s, d), ["ln", "flag", "price"], "y"), 9, "info_gain", "gain_ratio", "gini", "relevance", "distance"), 4, "chi_square")


@query(f"select round(ln((a * e) / (b * c)), 9) as log_odds from (select count(*) filter (where price = '0' and y = 'true')::double as a, count(*) filter (where price = '0' and y = 'false')::double as b, count(*) filter (where price <> '0' and y = 'true')::double as c, count(*) filter (where price <> '0' and y = 'false')::double as e from {_SC})")
def m7_log_odds(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.log_odds(_scored(s, d), "price", "0", "y", "true"), 9, "log_odds")


@query(f"""with l as (select 'ln' as attribute, ln as value, l_quantity as y from {_SC} union all select 'price', price, l_quantity from {_SC}), g as (select attribute, value, count(*) as n, sum(y) as s, sum(y * y) as q from l group by 1, 2),
  h as (select attribute, sum(n) as alls, sum(n) filter (where value is not null) as n, sum(s) filter (where value is not null) as s, sum(q) filter (where value is not null) as q, sum(q - s * s / n) filter (where value is not null) as i from g group by 1)
  select attribute, round((1 - i / (q - s * s / n)) * n / alls, 8) as mse from h""")
def m8_mse(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.mse(_scored(s, d), ["ln", "price"], "l_quantity"), 8, "mse")


def _relief_sql(regression: bool, last: str) -> str:
    """Neighbours of 50 reference rows of lineitem, with unknown prices and flags, then `last` over them (of reference row r and neighbour t: weight w, both v, differences)."""
    y = "l_discount" if regression else "case when l_quantity >= 25 then 'true' else 'false' end"
    of = "rk" if regression else "rk, y"
    weight = "abs(y - ry) / nullif(sy, 0) / n" if regression else "case when y = ry then -1 / n else (ny / (na - ny)::double) / n end"
    sy = "max(y) - min(y)" if regression else "0.0"
    return f"""with t as (select l_quantity / 1.0 as a, case when l_linenumber % 3 <> 0 then l_extendedprice end as b, l_tax as c, case when l_suppkey % 5 <> 0 then l_returnflag end as f, {y} as y, concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber) as k from lineitem),
  s as (select max(a) - min(a) as sa, max(b) - min(b) as sb, max(c) - min(c) as sc, avg(b) as mb, count(*) as na, {sy} as sy from t), ny as (select y, count(*) as ny from t group by 1),
  p as (select f, count(*) / sum(count(*)) over () as p from t where f is not null group by 1), pp as (select 1 - sum(p * p) as pp from p),
  x as (select t.*, p.p, ny.ny from t left join p using (f) join ny using (y)), ref as (select * from x order by md5(k), k limit 50),
  d as (select r.k as rk, r.y as ry, x.y, x.k, x.ny, abs(r.a - x.a) / sa as da, case when r.b is null and x.b is null then 0.5 else abs(coalesce(r.b, mb) - coalesce(x.b, mb)) / sb end as db, abs(r.c - x.c) / sc as dc,
    case when r.f is null and x.f is null then pp when r.f is null then 1 - x.p when x.f is null then 1 - r.p else (r.f <> x.f)::int::double end as df, r.f as rf, x.f as xf, r.a as ra, x.a as xa from ref r join x on x.k <> r.k, s, pp),
  n as (select * from d where da + db + dc + df > 0 qualify rank() over (partition by {of} order by round(da + db + dc + df, 12)) <= 10), m as (select *, count(*) over (partition by {of})::double as n from n),
  w as (select m.*, {weight} as w, 1 / n as v from m, s), nd as (select sum(w) as nd from w) {last}"""


_RELIEF_SCORE = {False: "sum(w * d) / 50", True: "sum(w * d) / any_value(nd) - (sum(v * d) - sum(w * d)) / (50 - any_value(nd))"}
_RELIEF_LONG = "(select unnest(['a', 'b', 'c', 'f']) as attribute, unnest([da, db, dc, df]) as d, w, v from w), nd"


def _relief(s: SparkSession, d: str, regression: bool) -> M.Neighbourhood:
    t = table(s, d, "lineitem").withColumn("y", F.col("l_discount") if regression else (F.col("l_quantity") >= 25).cast("string")).withColumn("k", F.concat_ws("|", *_ROW[:4]))
    t = t.select("k", "y", F.col("l_quantity").cast("double").alias("a"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice")).alias("b"), F.col("l_tax").alias("c"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_returnflag")).alias("f"))
    return M.relief_neighbours(t, ["a", "b", "c"], ["f"], "y", "k", 50, 10, regression)


@query(_relief_sql(False, f"select attribute, round({_RELIEF_SCORE[False]}, 7) as relief from {_RELIEF_LONG} group by 1"))
def m9_relief(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.relief_scores(_relief(s, d, False), ["a", "b", "c", "f"]), 7, "relief")


@query(_relief_sql(True, f"select attribute, round({_RELIEF_SCORE[True]}, 7) as relief from {_RELIEF_LONG} group by 1"))
def m9_rrelief(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.relief_scores(_relief(s, d, True), ["a", "b", "c", "f"]), 7, "relief")


@query("""with t as (select s_suppkey as k, s_suppkey * 7 % 11 / 1.0 as a, s_nationkey::varchar as f, s_acctbal >= 5000 as y from supplier), s as (select max(a) - min(a) as sa, count(*) as na from t), ny as (select y, count(*) as ny from t group by 1),
  ref as (select * from t order by md5(k::varchar), k limit 50), d as (select r.k as rk, r.y as ry, t.y, ny, r.f as rf, t.f as xf, (r.f <> t.f)::int as df, round(abs(r.a - t.a) / sa + (r.f <> t.f)::int, 12) as dist from ref r join t on t.k <> r.k join ny on ny.y = t.y, s),
  n as (select * from d where dist > 0 qualify rank() over (partition by rk, y order by dist) <= 30), w as (select n.*, case when y = ry then -1 else ny / (na - ny)::double end / count(*) over (partition by rk, y) as w from n, s)
  select least(rf, xf) as a, greatest(rf, xf) as b, round(sum(w) / (select count(*) from ref), 7) as gain from w where df = 1 group by 1, 2""")
def m10_relief_gains(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7 % 11).cast("double").alias("a"), F.col("s_nationkey").cast("string").alias("f"), (F.col("s_acctbal") >= 5000).alias("y"))
    return rounded(M.relief_gains(M.relief_neighbours(t, ["a"], ["f"], "y", "s_suppkey", 50, 30), "f"), 7, "gain")


@query(_relief_sql(True, """, e as (select distinct ra as x from w union select xa from w), c as (select x, (x + lead(x) over (order by x)) / 2 as cut from e), g as (select cut, sum(w) as ws, sum(v) as vs from c left join w on least(ra, xa) < cut and greatest(ra, xa) > cut where cut is not null group by 1)
  select cut, round(coalesce(ws, 0) / nd - (coalesce(vs, 0) - coalesce(ws, 0)) / (50 - nd), 7) as gain from g, nd"""))
def m10_relief_thresholds(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.relief_thresholds(_relief(s, d, True), "a"), 7, "gain")


@query(f"""with t as (select attribute, value, class, count(*)::double as w from {_LONG} group by 1, 2, 3), c as (select attribute, class, sum(w) as w from t group by 1, 2), k as (select attribute, count(*) as k, sum(w) as n, sum(lgamma(w + 1)) as g from c group by 1),
  v as (select attribute, value, sum(w) as n, sum(lgamma(w + 1)) as g from t where value is not null group by 1, 2), p as (select attribute, sum(lgamma(v.n + 1) - v.g + lgamma(v.n + k) - lgamma(v.n + 1) - lgamma(k)) as post from v join k using (attribute) group by 1)
  select attribute, round((lgamma(n + 1) - g + lgamma(n + k) - lgamma(n + 1) - lgamma(k) - post) / ln(2) / n, 7) as mdl from k join p using (attribute)""")
def m12_mdl(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.mdl(_scored(s, d), ["ln", "flag", "price"], "y"), 7, "mdl")


@query("""with t as (select l_quantity as x, l_discount > 0.05 as y, count(*)::double as w from lineitem group by 1, 2), e as (select a.x, b.y, coalesce(w, 0) as w from (select distinct x from t) a cross join (select distinct y from t) b left join t on t.x = a.x and t.y = b.y),
  c as (select x, sum(w) over (partition by y order by x) as l, sum(w) over (partition by y) as t from e), r as (select x, l, t, t - l as r from c),
  g as (select x, sum(l) as ls, sum(t) as ts, sum(r) as rs, sum(case when l > 0 then l * log2(l) else 0 end) as el, sum(t * log2(t)) as et, sum(case when r > 0 then r * log2(r) else 0 end) as er from r group by 1)
  select (x + lead(x) over (order by x)) / 2 as cut, round((ts * log2(ts) - et - (case when ls > 0 then ls * log2(ls) else 0 end - el) - (case when rs > 0 then rs * log2(rs) else 0 end - er)) / ts, 8) as gain from g qualify cut is not null""")
def m13_thresholds(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.thresholds(table(s, d, "lineitem").withColumn("y", F.col("l_discount") > 0.05), "l_quantity", "y"), 8, "gain")


@query(f"""with t as (select price as v, y, count(*)::double as w from {_SC} group by 1, 2), e as (select a.v, b.y, coalesce(w, 0) as l, b.t from (select distinct v from t) a cross join (select y, sum(w) as t from t group by 1) b left join t on t.v = a.v and t.y = b.y),
  h as (select v, sum(l) as ls, sum(t) as ts, sum(t - l) as rs, sum(case when l > 0 then l * log2(l) else 0 end) as el, sum(t * log2(t)) as et, sum(case when t > l then (t - l) * log2(t - l) else 0 end) as er from e group by 1)
  select v as value, round(((ts * log2(ts) - et) - (ls * log2(ls) - el) - (case when rs > 0 then rs * log2(rs) else 0 end - er)) / ts, 8) as gain from h order by gain desc, v limit 1""")
def m14_best_value(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.best_value(_scored(s, d), "price", "y"), 8, "gain")


@query(f"select attribute, info_gain as score from ({_SCORES})")
def m18_ranked(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.ranked(M.score_all(_scored(s, d), ["ln", "flag", "price"], "y"), "info_gain"), 9, "score")


@query("select case when l_quantity >= 25 then 'true' else 'false' end as y, case when l_quantity >= 30 then 'true' else 'false' end as big from lineitem")
def m19_select_best(s: SparkSession, d: str) -> DataFrame:
    t = _scored(s, d).withColumn("big", (F.col("l_quantity") >= 30).cast("string"))
    return M.select_best(t, M.score_all(t, ["ln", "big", "price"], "y"), "info_gain", 1, ["y"])


# -- statistics -----------------------------------------------------------------------------------------


@query("with o as (select round(o_totalprice, -2) as o_totalprice from orders) select round(avg(o_totalprice), 4) as mean, median(o_totalprice) as median, (select o_totalprice from o group by 1 order by count(*) desc, o_totalprice limit 1) as mode, round(exp(avg(ln(o_totalprice))), 4) as geometric_mean, round(count(*) / sum(1 / o_totalprice), 4) as harmonic_mean from o")
def c1_central(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.central(table(s, d, "orders").withColumn("o_totalprice", F.round("o_totalprice", -2)), "o_totalprice"), 4, "mean", "geometric_mean", "harmonic_mean")


@query("with m as (select avg(o_totalprice) as m from orders), k as (select m, avg((o_totalprice - m) ** 2) as m2, avg((o_totalprice - m) ** 3) as m3, avg((o_totalprice - m) ** 4) as m4 from orders, m group by m) select round(100 * sqrt(m2) / m, 6) as variation, round(m3 / m2 ** 1.5, 6) as skewness, round(m4 / (m2 * m2), 6) as kurtosis from k")
def c2_moments(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.moments(table(s, d, "orders"), "o_totalprice"), 6, "variation", "skewness", "kurtosis")


@query("select round(var_pop(l_quantity), 6) as samplevar, round(stddev_pop(l_quantity), 6) as samplestd, round(var_samp(l_quantity), 6) as var, round(stddev_samp(l_quantity), 6) as std, round(stddev_samp(l_quantity) / sqrt(count(*)), 8) as sterr, round(sum(l_quantity * l_quantity), 2) as ss from lineitem")
def c3_variability(s: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(rounded(C.variability(table(s, d, "lineitem"), "l_quantity"), 6, "samplevar", "samplestd", "var", "std"), 8, "sterr"), 2, "ss")


@query("with h as (select cast(least(floor(l_quantity / 5), 9) as integer) as bin, count(*) as n from lineitem where l_quantity between 0 and 50 group by 1) select bin, n, cast(sum(n) over (order by bin) as bigint) as cumulative, round(n / sum(n) over (), 9) as relative from h")
def c4_histogram(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.histogram(table(s, d, "lineitem"), "l_quantity", 10, 0, 50), 9, "relative")


@query("select o_totalprice as score from (select o_totalprice, row_number() over (order by o_totalprice) - 1 as n, count(*) over () as k from orders) where n = cast(floor(k * 0.3 + 0.5) as bigint)")
def c4_score_at_percentile(s: SparkSession, d: str) -> DataFrame:
    return C.score_at_percentile(table(s, d, "orders"), "o_totalprice", 30)


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) - 1 as r, count(*) over () as n from orders) where r >= floor(n * 0.1) and r < n - floor(n * 0.1)")
def c5_trim_both(s: SparkSession, d: str) -> DataFrame:
    return C.trim_both(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.1, ["o_orderkey"]).select("o_orderkey")


@query("select round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(corr(l_extendedprice, l_quantity), 8) as r from lineitem")
def c6_linregress(s: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(rounded(C.linregress(table(s, d, "lineitem"), "l_quantity", "l_extendedprice"), 6, "slope"), 4, "intercept"), 8, "r")


@query("with p as (select sign(a.s_acctbal - b.s_acctbal) as x, sign(a.s_nationkey - b.s_nationkey) as y from supplier a join supplier b on a.s_suppkey > b.s_suppkey) select round(sum(x * y) / sqrt(sum(abs(x)) * sum(abs(y))), 9) as tau from p")
def c6_kendall(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.kendall(table(s, d, "supplier"), "s_acctbal", "s_nationkey", "s_suppkey"), 9, "tau")


@query("with g as (select avg(l_extendedprice) filter (where f) - avg(l_extendedprice) filter (where not f) as dm, count(*) filter (where f) as n1, count(*) filter (where not f) as n2, var_samp(l_extendedprice) filter (where f) as v1, var_samp(l_extendedprice) filter (where not f) as v2 from (select l_extendedprice, l_returnflag = 'A' as f from lineitem)) select round(dm / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) as t, n1 + n2 - 2 as df from g")
def c7_ttest_ind(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.ttest_ind(table(s, d, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "A"), 6, "t")


@query("with c as (select count(*)::double as n from orders group by o_orderpriority) select round(sum((n - e) * (n - e) / e), 6) as chi2, count(*) - 1 as df from c, (select avg(n) as e from c)")
def c7_chisquare(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.chisquare(table(s, d, "orders"), "o_orderpriority"), 6, "chi2")


@query("with g as (select o_orderpriority, count(*)::double as n, sum(o_totalprice) as s, sum(o_totalprice * o_totalprice) as q from orders group by 1) select round(((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))), 5) as f from g")
def c7_anova(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.anova(table(s, d, "orders"), "o_totalprice", "o_orderpriority"), 5, "f")


@query("with r as (select l_returnflag = 'A' as f, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0::double as r from lineitem) select sum(r) filter (where f) - count(*) filter (where f)::double * (count(*) filter (where f) + 1) / 2 as u, count(*) filter (where f) as n1, count(*) filter (where not f) as n2 from r")
def c7_mann_whitney(s: SparkSession, d: str) -> DataFrame:
    return C.mann_whitney(table(s, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "A")


@query("with d as (select l_quantity - 25 as d from lineitem where l_quantity <> 25), r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0::double as r from d) select sum(r) filter (where d > 0) as w_plus, sum(r) filter (where d < 0) as w_minus from r")
def c7_wilcoxon(s: SparkSession, d: str) -> DataFrame:
    return C.wilcoxon(table(s, d, "lineitem").withColumn("m", F.lit(25.0)), "l_quantity", "m")


@query("""with t as (select l_returnflag as a, l_linestatus as b, count(*)::double as o from lineitem group by 1, 2), r as (select a, sum(o) as n from t group by 1), c as (select b, sum(o) as n from t group by 1), w as (select sum(o) as n from t),
  x as (select sum((coalesce(o, 0) - r.n * c.n / w.n) ** 2 / (r.n * c.n / w.n)) as chi2, any_value(w.n) as n, count(distinct a) as ka, count(distinct b) as kb from r cross join c cross join w left join t using (a, b))
  select round(chi2, 4) as chi2, (ka - 1) * (kb - 1) as df, round(exp(-chi2 / 2), 9) as p, round(sqrt(chi2 / (n * (least(ka, kb) - 1))), 9) as cramers_v, round(sqrt(chi2 / (chi2 + n)), 9) as contingency from x""")
def c7_chisquare2d(s: SparkSession, d: str) -> DataFrame:
    """Of two degrees of freedom the probability is e^(-chi2 / 2)."""
    return rounded(rounded(C.chisquare2d(table(s, d, "lineitem"), "l_returnflag", "l_linestatus"), 9, "p", "cramers_v", "contingency"), 4, "chi2")


_MEASURES = "(select s_suppkey as s, 'a' as t, s_acctbal as x from supplier union all select s_suppkey, 'b', s_acctbal * 1.1 + s_suppkey % 7 * 40 from supplier union all select s_suppkey, 'c', abs(s_acctbal) from supplier)"


@query(f"""with m as {_MEASURES}, g as (select avg(x) as g, count(distinct s) as n, count(distinct t) as k from m), a as (select t, avg(x) as m from m group by 1), b as (select s, avg(x) as m from m group by 1),
  bt as (select sum((m - g) ** 2) * any_value(n) as v from a, g), er as (select sum((x - a.m - b.m + g) ** 2) as v from m join a using (t) join b using (s), g),
  f as (select (bt.v / (k - 1)) / (er.v / ((k - 1) * (n - 1))) as f, k - 1 as df_between, (k - 1) * (n - 1) as df_error from bt, er, g)
  select round(f, 6) as f, df_between, df_error, round(pow(1 + 2 * f / df_error, -df_error / 2), 9) as p from f""")
def c7_anova_rel(s: SparkSession, d: str) -> DataFrame:
    """Of two degrees between, the probability is (1 + 2 f / d)^(-d / 2), d those of the error."""
    b, k = F.col("s_acctbal"), F.col("s_suppkey")
    x = F.explode(F.array(*(F.struct(F.lit(n).alias("t"), v.cast("double").alias("x")) for n, v in (("a", b), ("b", b * 1.1 + k % 7 * 40), ("c", F.abs(b)))))).alias("m")
    t = table(s, d, "supplier").select(k.alias("s"), x).select("s", "m.*")
    return rounded(rounded(C.anova_rel(t, "s", "t", "x"), 6, "f"), 9, "p")


@query("with r as (select l_returnflag = 'A' as f, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0::double as r from lineitem), u as (select sum(r) filter (where f) as s, count(*) filter (where f)::double as a, count(*) filter (where not f)::double as b from r) select round((s - a * (a + b + 1) / 2) / sqrt(a * b * (a + b + 1) / 12), 9) as z from u")
def c7_ranksums(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.ranksums(table(s, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "A"), 9, "z").select("z")


@query("select event_id, round(sin(value) + cos(value), 9) as wave, round(sqrt(value * value + 1), 9) as hyp, round(atan2(value, 3), 9) as angle, round(value % 7, 6) as rest from events")
def c11_math(s: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(s, d, "events").select("event_id", F.round(F.sin(v) + F.cos(v), 9).alias("wave"), F.round(F.sqrt(v * v + 1), 9).alias("hyp"), F.round(F.atan2(v, F.lit(3.0)), 9).alias("angle"), F.round(v % 7, 6).alias("rest"))
