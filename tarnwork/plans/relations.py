"""Projections, filters, joins, sets and orderings over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork import schema as S
from tarnwork.operators import filters as P
from tarnwork.operators import relational as R
from tarnwork.operators.distance import against_all
from tarnwork.plans.registry import query, sql_uniform, table

#: Lineitem with unknown values, as the tables have none.
LI_SQL = "(select l_orderkey, l_partkey, l_suppkey, l_linenumber, nullif(l_linenumber, 3) as ln, case when l_tax > 0.05 then null else l_tax end as tax, l_quantity, l_extendedprice, l_discount, l_tax, case when l_returnflag = 'N' then null else l_returnflag end as flag, l_returnflag, l_linestatus, l_shipdate from lineitem)"


def lineitem(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.nullif("l_linenumber", F.lit(3)).alias("ln"), F.when(~(F.col("l_tax") > 0.05), F.col("l_tax")).alias("tax"), "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), "l_returnflag", "l_linestatus", "l_shipdate",
    )


@query("select l_orderkey, l_quantity * 2 as twice, l_returnflag, cast(null as double) as missing from lineitem")
def p1_translate(s: SparkSession, d: str) -> DataFrame:
    target = S.Domain((S.Variable("l_orderkey", role="meta"), S.Variable("twice", compute=lambda df: F.col("l_quantity") * 2), S.Variable("l_returnflag", "discrete", "class"), S.Variable("missing")))
    return S.convert(table(s, d, "lineitem"), target)


@query("select p_partkey, p_brand, p_size from part")
def p3_select(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").drop("p_name", "p_type", "p_retailprice")


@query("select c_custkey, c_acctbal from customer")
def p4_take_columns(s: SparkSession, d: str) -> DataFrame:
    return R.take_columns(table(s, d, "customer"), [True, False, False, True, False])


@query("select s_suppkey, 1.0::double as w from supplier")
def p6_add_meta(s: SparkSession, d: str) -> DataFrame:
    return R.add_meta(table(s, d, "supplier").select("s_suppkey"), "w")


@query("select o_orderkey, cast(row_number() over (order by o_orderkey) - 1 + 5 as varchar) as row_id from orders")
def p7_row_id(s: SparkSession, d: str) -> DataFrame:
    return R.add_row_id(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 5)


@query("select count(*) as n, count(*) as ids, count(*) as uuids, 36 as longest from region")
def p8_uuid_range(s: SparkSession, d: str) -> DataFrame:
    """New ids and UUIDs differ from row to row."""
    t = R.add_uuid(R.add_range(table(s, d, "region"), ["r_regionkey"], "id", 10), "uuid")
    return t.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("uuid").alias("uuids"), F.max(F.length("uuid")).alias("longest"))


@query("""select a.s_suppkey, a.s_name, coalesce(a.x, b.x) as x, b.s_acctbal from
  (select s_suppkey, s_name, nullif(s_nationkey, 3) as x, row_number() over (order by s_suppkey) as n from supplier) a
  join (select s_acctbal, s_nationkey as x, row_number() over (order by s_suppkey) as n from supplier) b on a.n = b.n""")
def p9_hstack(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "supplier")
    left = t.select("s_suppkey", "s_name", F.nullif("s_nationkey", F.lit(3)).alias("x"))
    right = t.select("s_acctbal", F.col("s_nationkey").alias("x"), F.col("s_suppkey").alias("k"))
    return R.hstack(left, right, ["s_suppkey"], ["k"]).drop("k")


@query("""with a as (select p_partkey, p_retailprice * (1 + p_size / 100.0) as gross from part), b as (select *, sqrt(gross) as root from a)
  select p_partkey, round(gross, 6) as gross, round(root, 6) as root, case when gross - 1000 > 0 then round(ln(gross - 1000), 6) end as loss from b""")
def p10_feature_constructor(s: SparkSession, d: str) -> DataFrame:
    t = R.construct(table(s, d, "part"), {"root": "sqrt(gross)", "gross": "p_retailprice * (1 + p_size / 100.0D)", "loss": "ln(nullif(greatest(gross - 1000, 0), 0))"})
    return t.select("p_partkey", F.round("gross", 6).alias("gross"), F.round("root", 6).alias("root"), F.round("loss", 6).alias("loss"))


@query("select c_custkey, case when c_acctbal > 0 then round(ln(c_acctbal), 9) end as c_acctbal from customer")
def p11_log(s: SparkSession, d: str) -> DataFrame:
    return R.log_transform(table(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 9))


@query("select o_orderkey, case o_orderstatus when 'F' then 'final' when 'O' then 'open' else o_orderstatus end as status from orders")
def p12_edit_domain(s: SparkSession, d: str) -> DataFrame:
    return R.edit_domain(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), {"o_orderstatus": "status"}, {"o_orderstatus": {"F": "final", "O": "open"}})


@query("""select attribute, string_agg(value, ',' order by value) as used, count(*) as n from
  (select distinct 'o_orderstatus' as attribute, o_orderstatus as value from orders union select distinct 'o_orderpriority', o_orderpriority from orders) group by 1""")
def p15_purge_domain(s: SparkSession, d: str) -> DataFrame:
    return R.used_values(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(f"select 'flag' as attribute, flag as value, count(*)::double as weight from {LI_SQL} where flag is not null group by flag union all select 'l_linestatus', l_linestatus, count(*) from lineitem group by 2")
def p16_value_weights(s: SparkSession, d: str) -> DataFrame:
    return R.value_weights(lineitem(s, d), ["flag", "l_linestatus"])


@query("select n_nationkey, n_name from nation")
def p17_single_valued(s: SparkSession, d: str) -> DataFrame:
    return R.without_single_valued(table(s, d, "nation").select("n_nationkey", "n_name", F.lit("x").alias("one")), ["n_name", "one"])


@query("""select feature, max(case when r_regionkey = 0 then v end) as "0", max(case when r_regionkey = 1 then v end) as "1", max(case when r_regionkey = 2 then v end) as "2", max(case when r_regionkey = 3 then v end) as "3", max(case when r_regionkey = 4 then v end) as "4" from
  (select r_regionkey, 'twice' as feature, r_regionkey * 2.0::double as v from region union all select r_regionkey, 'half', r_regionkey / 2.0::double from region) group by feature""")
def p19_transpose(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "region").select("r_regionkey", (F.col("r_regionkey") * F.lit(2.0)).alias("twice"), (F.col("r_regionkey") / 2).alias("half"))
    return R.transpose(t, ["twice", "half"], "r_regionkey")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 45 and l_returnflag in ('A', 'R')")
def f1_filter(s: SparkSession, d: str) -> DataFrame:
    return P.accepts(table(s, d, "lineitem"), P.conjunction(P.continuous("l_quantity", ">=", 45), P.discrete("l_returnflag", ["A", "R"]))).select("l_orderkey", "l_linenumber", "l_quantity")


@query("select o_orderkey, o_orderkey % 5 as fold from orders where o_orderkey % 5 = 2")
def f2_select_fold(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("fold")).where("fold = 2")


@query("""select i.item, p_partkey from (select p_partkey, row_number() over (order by p_partkey) - 1 as n from part) p join (select * from (values (0, 3), (1, 1), (2, 3), (3, 100)) v(item, n)) i on i.n = p.n""")
def f3_get_items(s: SparkSession, d: str) -> DataFrame:
    return R.get_items(table(s, d, "part").select("p_partkey"), [3, 1, 3, 100], ["p_partkey"]).select(F.col("item").cast("int").alias("item"), "p_partkey")


@query(f"""select count(*) filter (where coalesce(ln = 2, false)) as eq, count(*) filter (where coalesce(ln <> 2, false)) as ne, count(*) filter (where coalesce(tax < 0.03, true)) as lt,
  count(*) filter (where coalesce(tax between 0.02 and 0.04, false)) as between_, count(*) filter (where coalesce(tax < 0.02 or tax > 0.04, false)) as outside from {LI_SQL}""")
def f4_continuous(s: SparkSession, d: str) -> DataFrame:
    tests = {"eq": P.continuous("ln", "=", 2), "ne": P.continuous("ln", "!=", 2), "lt": P.continuous("tax", "<", 0.03, special=1), "between_": P.continuous("tax", "between", 0.02, 0.04), "outside": P.continuous("tax", "outside", 0.02, 0.04)}
    return lineitem(s, d).agg(*(F.count_if(c == 1).alias(n) for n, c in tests.items()))


@query(f"select count(*) filter (where coalesce(flag in ('A'), false)) as a, count(*) filter (where coalesce(flag in ('A'), true)) as a_special, count(*) filter (where flag is not null and flag not in ('A')) + count(*) filter (where flag is null) as not_a from {LI_SQL}")
def f5_discrete(s: SparkSession, d: str) -> DataFrame:
    tests = {"a": P.discrete("flag", ["A"]), "a_special": P.discrete("flag", ["A"], special=1), "not_a": P.discrete("flag", ["A"], negate=True)}
    return lineitem(s, d).agg(*(F.count_if(c == 1).alias(n) for n, c in tests.items()))


@query("""select count(*) filter (where p_name < 'g') as lt, count(*) filter (where p_name >= 'c' and p_name <= 'k') as between_, count(*) filter (where p_name < 'c' or p_name > 'k') as outside,
  count(*) filter (where contains(lower(p_type), 'a')) as has, count(*) filter (where not contains(p_type, 'a')) as hasnt, count(*) filter (where starts_with(p_brand, 'Brand#1')) as begins, count(*) filter (where ends_with(p_brand, '1')) as ends from part""")
def f6_string(s: SparkSession, d: str) -> DataFrame:
    tests = {
        "lt": P.string("p_name", "<", "g"), "between_": P.string("p_name", "between", "c", "k"), "outside": P.string("p_name", "outside", "c", "k"), "has": P.string("p_type", "contains", "A", case_sensitive=False),
        "hasnt": P.string("p_type", "not_contains", "a"), "begins": P.string("p_brand", "begins", "Brand#1"), "ends": P.string("p_brand", "ends", "1"),
    }
    return table(s, d, "part").agg(*(F.count_if(c == 1).alias(n) for n, c in tests.items()))


@query("select doc_id, lang from documents where lower(lang) in ('de', 'fr')")
def f7_string_list(s: SparkSession, d: str) -> DataFrame:
    return P.accepts(table(s, d, "documents").select("doc_id", "lang"), P.string_list("lang", ["DE", "fr"], case_sensitive=False))


@query(f"select l_orderkey, l_linenumber, l_partkey from {LI_SQL} where (coalesce(ln = 2, true) and coalesce(tax < 0.02, true)) or coalesce(flag = 'A' and l_quantity > 48, false)")
def f8_values(s: SparkSession, d: str) -> DataFrame:
    one = P.conjunction(P.continuous("ln", "=", 2, special=-1), P.continuous("tax", "<", 0.02, special=-1))
    two = P.conjunction(P.discrete("flag", ["A"]), P.continuous("l_quantity", ">", 48))
    return P.accepts(lineitem(s, d), P.disjunction(one, two)).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"select count(*) as n from {LI_SQL} where ln is not null and tax is not null and flag is not null")
def f9_defined(s: SparkSession, d: str) -> DataFrame:
    return P.accepts(lineitem(s, d), P.is_defined("ln", "tax", "flag")).agg(F.count("*").alias("n"))


@query(f"select count(*) as n from {LI_SQL} where ln is null or tax is null")
def f10_special(s: SparkSession, d: str) -> DataFrame:
    return P.accepts(lineitem(s, d), P.has_special("ln", "tax")).agg(F.count("*").alias("n"))


@query(f"select l_orderkey, l_partkey, flag from {LI_SQL} where flag is not null")
def f11_has_class(s: SparkSession, d: str) -> DataFrame:
    return lineitem(s, d).where("flag is not null").select("l_orderkey", "l_partkey", "flag")


@query("select event_id from events where props like '%\"k\"%' and event_id % 2 = 0")
def f12_has_meta(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.from_json("props", "map<string, double>")).alias("metas"))
    return P.accepts(t, P.has_meta("metas", "k")).select("event_id")


@query(f"select count(*) filter (where flag is not distinct from null) as unknown, count(*) filter (where flag is not distinct from 'A') as a from {LI_SQL}")
def f13_same_value(s: SparkSession, d: str) -> DataFrame:
    return lineitem(s, d).agg(F.count_if(P.same_value("flag", None) == 1).alias("unknown"), F.count_if(P.same_value("flag", "A") == 1).alias("a"))


@query(f"select count(*) filter (where ln is not distinct from 1 and flag is not distinct from null) as same, count(*) filter (where (ln is null or ln = 1) and (flag is null or flag = 'A')) as compatible from {LI_SQL}")
def f14_same_example(s: SparkSession, d: str) -> DataFrame:
    return lineitem(s, d).agg(F.count_if(P.same_example({"ln": 1, "flag": None}) == 1).alias("same"), F.count_if(P.compatible({"ln": 1, "flag": "A"}) == 1).alias("compatible"))


@query("select count(*) filter (where o_orderstatus = 'F' and o_totalprice > 100000) as both_, count(*) filter (where o_orderstatus = 'F' or o_totalprice > 100000) as either from orders")
def f15_combined(s: SparkSession, d: str) -> DataFrame:
    a, b = P.discrete("o_orderstatus", ["F"]), P.continuous("o_totalprice", ">", 100000)
    return table(s, d, "orders").agg(F.count_if(P.conjunction(a, b) == 1).alias("both_"), F.count_if(P.disjunction(a, b) == 1).alias("either"))


@query(f"select o_orderkey from orders where {sql_uniform(7, 'o_orderkey')} < 0.1")
def f16_random(s: SparkSession, d: str) -> DataFrame:
    return P.random(table(s, d, "orders").select("o_orderkey"), 0.1, ["o_orderkey"], 7)


@query("select count(*) as accepted from lineitem where l_discount > 0.05")
def f17_count(s: SparkSession, d: str) -> DataFrame:
    return P.count(table(s, d, "lineitem"), P.continuous("l_discount", ">", 0.05))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem where not (l_returnflag in ('A') and l_linestatus in ('F')) group by all")
def f18_drop(s: SparkSession, d: str) -> DataFrame:
    return P.drop(table(s, d, "lineitem"), {"l_returnflag": ["A"], "l_linestatus": ["F"]}).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query(f"select count(*) filter (where ln is null or tax is null) as take, count(*) filter (where not (ln is null or tax is null)) as drop_, count(*) filter (where flag is null) as classes from {LI_SQL}")
def f19_missing(s: SparkSession, d: str) -> DataFrame:
    m = P.has_special("ln", "tax")
    return lineitem(s, d).agg(F.count_if(m == 1).alias("take"), F.count_if(m == 0).alias("drop_"), F.count_if(F.col("flag").isNull()).alias("classes"))


@query(f"select l_orderkey, l_partkey, l_quantity from {LI_SQL} where (l_quantity < 2 and flag is not null) or (not coalesce(ln in (1, 2), false) and l_quantity >= 50 and ln is not null)")
def f21_select_data(s: SparkSession, d: str) -> DataFrame:
    one = P.conjunction(P.continuous("l_quantity", "<", 2), P.is_defined("flag"))
    two = P.conjunction(P.discrete("ln", ["1", "2"], negate=True, special=1), P.continuous("l_quantity", ">=", 50))
    return P.accepts(lineitem(s, d), P.disjunction(one, two)).select("l_orderkey", "l_partkey", "l_quantity")


@query(f"select l_orderkey, l_partkey from {LI_SQL} where tax is null")
def f22_missing_rows(s: SparkSession, d: str) -> DataFrame:
    return P.accepts(lineitem(s, d), P.has_special("tax")).select("l_orderkey", "l_partkey")


@query(f"select coalesce(bool_or(ln is null or tax is null), false) as missing_values, coalesce(bool_or(flag is null), false) as missing_classes from {LI_SQL}")
def f23_has_missing(s: SparkSession, d: str) -> DataFrame:
    return P.missing_summary(lineitem(s, d), ["ln", "tax"], "flag")


@query("""with a as (select s_suppkey as k, nullif(s_nationkey % 4, 3) as x, nullif(s_suppkey % 3, 2) as y from supplier)
  select a.k as i, b.k as j from a join a b on a.k > b.k and (a.x is null or b.x is null or a.x = b.x) and (a.y is null or b.y is null or a.y = b.y)""")
def f24_compatible_pairs(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.nullif(F.col("s_nationkey") % 4, F.lit(3)).alias("x"), F.nullif(F.col("s_suppkey") % 3, F.lit(2)).alias("y"))
    a, b = against_all(t, "k")
    return a.join(b, (F.col("a.k") > F.col("b.k")) & P.compatible_pair("a", "b", ["x", "y"])).select(F.col("a.k").alias("i"), F.col("b.k").alias("j"))


_C = "(select c_custkey, c_name, nullif(c_nationkey, 7) as nk from customer)"


def _customers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", "c_name", F.nullif("c_nationkey", F.lit(7)).alias("nk"))


@query(f"select c_custkey, c_name, nk, n_name, n_regionkey from {_C} c left join (select nullif(n_nationkey, 5) as k, n_name, n_regionkey from nation) n on c.nk = n.k")
def j1_left_join(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").select(F.nullif("n_nationkey", F.lit(5)).alias("k"), "n_name", "n_regionkey")
    return R.equi_join(_customers(s, d), n, ["nk"], ["k"]).drop("k")


@query(f"select c_custkey, n.k, n_name from {_C} c right join (select nullif(n_nationkey, 5) as k, n_name from nation) n on c.nk = n.k")
def j2_right_join(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").select(F.nullif("n_nationkey", F.lit(5)).alias("k"), "n_name")
    return R.equi_join(_customers(s, d).select("c_custkey", "nk"), n, ["nk"], ["k"], "right").drop("nk")


@query("""select c_custkey, o_orderkey, o_totalprice from customer left join (select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1) o on c_custkey = o_custkey""")
def j3_lookup_join(s: SparkSession, d: str) -> DataFrame:
    return R.lookup_join(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["c_custkey"], ["o_custkey"], ["o_orderkey"]).drop("o_custkey")


@query(f"""select c_custkey, first_name from {_C} c left join (select k, reg, n_name as first_name from (select nullif(n_nationkey, 5) as k, n_nationkey % 2 as reg, n_name, n_nationkey from nation) qualify row_number() over (partition by k, reg order by n_nationkey) = 1) n
  on c.nk is not distinct from n.k and c.c_custkey % 2 = n.reg""")
def j4_multi_key_join(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").select(F.nullif("n_nationkey", F.lit(5)).alias("k"), (F.col("n_nationkey") % 2).alias("reg"), F.col("n_name").alias("first_name"), "n_nationkey")
    c = _customers(s, d).withColumn("odd", F.col("c_custkey") % 2)
    return R.lookup_join(c, n, ["nk", "odd"], ["k", "reg"], ["n_nationkey"], unknown_matches=True).select("c_custkey", "first_name")


@query("select concat(p_brand, '-', cast(p_size as varchar)) as cell, count(*) as n from part group by 1")
def j10_cartesian(s: SparkSession, d: str) -> DataFrame:
    return R.cartesian_feature(table(s, d, "part"), ["p_brand", "p_size"], "cell").groupBy("cell").agg(F.count("*").alias("n"))


@query("select c_custkey as k, c_name as name, null::double as s_acctbal from customer union all select s_suppkey, s_name, s_acctbal from supplier")
def u1_vstack(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit(None).cast("double").alias("s_acctbal"))
    return R.vstack(a, table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), "s_acctbal"))


@query("select c_name as name, c_nationkey as nk, 'c' as source from customer union all select s_name, s_nationkey, 's' from supplier")
def u2_concatenate(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nk"), "c_mktsegment")
    b = table(s, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nk"), "s_acctbal")
    return R.concatenate({"c": a, "s": b}, union=False, source="source")


@query(f"select ln, flag, l_linestatus, round(sum(l_quantity), 6) as weight from {LI_SQL} group by all")
def u3_remove_duplicates(s: SparkSession, d: str) -> DataFrame:
    return R.remove_duplicates(lineitem(s, d), ["ln", "flag", "l_linestatus"], F.col("l_quantity")).withColumn("weight", F.round("weight", 6))


@query(f"select count(*) as n from {LI_SQL} where not ((ln is null or ln = 1) and (flag is null or flag = 'A'))")
def u4_remove_compatible(s: SparkSession, d: str) -> DataFrame:
    return P.accepts(lineitem(s, d), P.compatible({"ln": 1, "flag": "A"}), negate=True).agg(F.count("*").alias("n"))


@query("select o_orderkey, o_orderpriority, row_number() over (order by case o_orderstatus when 'P' then 1 when 'O' then 2 else 3 end, o_orderkey) as place from orders")
def u5_sort(s: SparkSession, d: str) -> DataFrame:
    values = ["P", "O", "F"]
    t = table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    t = R.numbered(t, [F.array_position(F.array(*map(F.lit, values)), F.col("o_orderstatus")).asc_nulls_last(), F.col("o_orderkey").asc_nulls_last()], "place", 1)
    return R.sorted_by(t, ["o_orderstatus", "o_orderkey"], values={"o_orderstatus": values}).select("o_orderkey", "o_orderpriority", "place")


@query("select c_custkey, nk from (select c_custkey, nullif(c_nationkey, 7) as nk from customer) order by nk desc nulls first, c_custkey")
def u6_data_sort(s: SparkSession, d: str) -> DataFrame:
    return R.sorted_by(_customers(s, d).select("c_custkey", "nk"), ["nk", "c_custkey"], [True, False])


@query(f"""with a as (select c_custkey, c_mktsegment, row_number() over (order by c_custkey) as n from customer), b as (select c_acctbal, row_number() over (order by {sql_uniform(3, 'c_custkey')}, c_custkey) as n from customer)
  select c_custkey, c_mktsegment, c_acctbal from a join b using (n)""")
def u7_shuffle_columns(s: SparkSession, d: str) -> DataFrame:
    return R.shuffle_columns(table(s, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), ["c_acctbal"], ["c_custkey"], 3)


@query("select p_partkey, p_name from (select *, row_number() over (order by p_partkey) - 1 as n from part) where n between 10 and 19")
def u9_slice(s: SparkSession, d: str) -> DataFrame:
    return R.numbered(table(s, d, "part").select("p_partkey", "p_name"), ["p_partkey"]).where("_no between 10 and 19").drop("_no")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def u10_top(s: SparkSession, d: str) -> DataFrame:
    return R.top(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, ["o_orderkey"])


@query("select o_custkey, min(o_orderkey) filter (where o_totalprice = price) as best, any_value(price) as price from (select *, max(o_totalprice) over (partition by o_custkey) as price from orders) group by 1")
def u11_best(s: SparkSession, d: str) -> DataFrame:
    """Each customer's dearest order, of equals that of the smallest key."""
    rank = F.when(F.col("o_totalprice").isNotNull(), F.struct("o_totalprice", -F.col("o_orderkey")))
    return table(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", rank).alias("best"), F.max("o_totalprice").alias("price"))


@query("select p_partkey, p_retailprice + 1 as price, p_brand from part")
def u12_average_tables(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"), "p_brand")
    return R.average_tables([t, t.withColumn("price", F.col("price") + 1), t.withColumn("price", F.col("price") + 5)], "p_partkey", ["price"], ["p_brand"])


@query("""with a as (select s_suppkey as k, s_nationkey as b, s_acctbal as x from supplier), r as (select max(x) - min(x) as span from a)
  select a.k as i, b.k as j, round(abs(a.x - b.x) / span, 9) as d from a join a b on a.b = b.b and a.k > b.k, r""")
def j7_distance_join(s: SparkSession, d: str) -> DataFrame:
    from tarnwork.operators.distance import distance_matrix

    t = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("b"), F.col("s_acctbal").alias("x"))
    return distance_matrix(t, "k", ["x"], "manhattan", block="b").withColumn("d", F.round("d", 9))
