"""Round trips through the file formats: written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators.distance import MOST_SENT
from tarnwork.operators.relational import checked_broadcast, numbered
from tarnwork.plans.registry import query, table
from tarnwork.schema import values_of, with_roles
from tarnwork.session import pinned, shared_dir
from tarnwork.sources import readers, writers


def _path(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/formats/{uuid.uuid4().hex}-{name}"


def _customers(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "customer").select(F.col("c_custkey").cast("double").alias("c_custkey"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment", "c_name")
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return with_roles(t, class_var="c_mktsegment", metas=["c_name"], discrete={"c_mktsegment": segments})


_SQL = "select c_custkey::double as c_custkey, case when c_acctbal > 0 then c_acctbal end as c_acctbal, c_mktsegment, c_name from customer"


@query(_SQL)
def s2_k2_tab(s: SparkSession, d: str) -> DataFrame:
    path = _path(s, "c.tab")
    writers.write(_customers(s, d), path)
    return readers.read(s, path)


@query(_SQL)
def s3_k2_prefixed(s: SparkSession, d: str) -> DataFrame:
    path = _path(s, "c.txt")
    writers.write(_customers(s, d), path)
    return readers.read(s, path)


@query(_SQL)
def s4_k3_csv(s: SparkSession, d: str) -> DataFrame:
    path = _path(s, "c.csv")
    writers.write(_customers(s, d), path)
    return readers.read(s, path)


@query(_SQL)
def s8_k6_arff(s: SparkSession, d: str) -> DataFrame:
    path = _path(s, "c.arff")
    writers.write(_customers(s, d), path)
    return readers.read(s, path)


@query("select c_custkey::double as c_custkey, case when c_acctbal > 0 then c_acctbal end as c_acctbal, c_mktsegment as class from customer")
def s6_k5_c45(s: SparkSession, d: str) -> DataFrame:
    path = _path(s, "c")
    t = _customers(s, d).drop("c_name").withColumnRenamed("c_mktsegment", "class")
    writers.write_c45(with_roles(t, class_var="class", discrete={"class": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]}), path, "class")
    return readers.read_c45(s, path)


@query("select o_orderstatus as item, count(*)::double as q from orders where o_custkey is not null group by 1")
def s5_k4_basket(s: SparkSession, d: str) -> DataFrame:
    path = _path(s, "o.basket")
    baskets = table(s, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").cast("double").alias("q")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "q"))).alias("items"))
    writers.write(baskets, path)
    return readers.read(s, path).select(F.explode("items").alias("item", "q")).groupBy("item").agg(F.sum("q").alias("q"))


@query("select l_returnflag = 'A' as a, count(*) as n from lineitem group by 1")
def s10_k6_libsvm(s: SparkSession, d: str) -> DataFrame:
    path = _path(s, "l.svm")
    t = table(s, d, "lineitem").select((F.col("l_returnflag") == "A").cast("double").alias("y"), "l_quantity", "l_tax")
    writers.write_libsvm(t, path, "y", ["l_quantity", "l_tax"])
    return readers.read(s, path).groupBy((F.col("label") == 1).alias("a")).agg(F.count("*").alias("n"))


@query("select c_mktsegment, count(*)::double as n from customer group by 1")
def s11_sql(s: SparkSession, d: str) -> DataFrame:
    table(s, d, "customer").createOrReplaceTempView("tarnwork_customer")
    return readers.read_sql(s, None, "select c_mktsegment, cast(count(*) as double) as n from tarnwork_customer group by 1", discrete=["c_mktsegment"])


@query("select a.x as flag, b.x as status, c.x as segment from (select distinct l_returnflag as x from lineitem) a, (select distinct l_linestatus as x from lineitem) b, (select distinct c_mktsegment as x from customer) c")
def s18_enumerate(s: SparkSession, d: str) -> DataFrame:
    found = values_of(table(s, d, "lineitem"), "l_returnflag", "l_linestatus") | values_of(table(s, d, "customer"), "c_mktsegment")
    return readers.enumerate_rows(s, dict(zip(("flag", "status", "segment"), found.values(), strict=True)))


@query("select a.s_suppkey as i, b.s_suppkey as j, round(abs(a.s_acctbal - b.s_acctbal), 4) as d from supplier a join supplier b on a.s_suppkey > b.s_suppkey")
def s21_k12_distance_file(s: SparkSession, d: str) -> DataFrame:
    path = _path(s, "m.dst")
    t = pinned(numbered(table(s, d, "supplier").select("s_suppkey", "s_acctbal"), ["s_suppkey"], "i"))  # keys may have gaps: rows go by number, keys are the labels
    if (n := t.count()) <= MOST_SENT:
        every = t.agg(F.array_sort(F.collect_list(F.struct("i", "s_acctbal")))["s_acctbal"].alias("every"))
        d = F.transform(F.slice("every", F.lit(1), F.col("i").cast("int")), lambda x: F.round(F.abs(F.col("s_acctbal") - x), 4))
        writers.write_distance_rows(t.withColumnRenamed("s_suppkey", "label"), path, n, d, every)
    else:
        a, b = t.alias("a"), t.alias("b")
        m = a.join(b, F.col("a.i") > F.col("b.i")).select(F.col("a.i").alias("i"), F.col("b.i").alias("j"), F.round(F.abs(F.col("a.s_acctbal") - F.col("b.s_acctbal")), 4).alias("d"))
        writers.write_distance_matrix(m, path, n, t.select("i", F.col("s_suppkey").alias("label")))
    key = pinned(readers.read_distance_labels(s, path).select("i", F.col("label").cast("long").alias("key")))
    i, j = (checked_broadcast(key.select(F.col("i").alias(c), F.col("key").alias(f"_{c}"))) for c in "ij")
    return readers.read_distance_matrix(s, path).join(i, "i").join(j, "j").select(F.col("_i").alias("i"), F.col("_j").alias("j"), "d")


@query("select bit_xor(('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderpriority)), 1, 15))::bigint) as checksum, count(*) as n from orders")
def k11_checksum(s: SparkSession, d: str) -> DataFrame:
    return writers.checksum(table(s, d, "orders"))


@query("select event_type, count(*) as n from events group by 1")
def streaming_counts(s: SparkSession, d: str) -> DataFrame:
    """A stream's running counts equal the batch's (an extension)."""
    from tarnwork.streaming import live

    t = table(s, d, "events").select("event_type", "user_id")
    path = _path(s, "events")
    t.write.parquet(path)
    stream = live.read_stream(s, path, t.schema.simpleString()[7:-1].replace(":", " "))
    name = f"counts_{uuid.uuid4().hex}"
    q = stream.groupBy("event_type").agg(F.count("*").alias("n")).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", _path(s, "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.table(name)
