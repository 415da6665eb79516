"""Queries over the whole of their tables: against brute force, or SQL that has none of their former filters and limits."""

import glob
import importlib
import os

import duckdb
import numpy as np
import pytest

from tarnwork.operators import distance as D
from tarnwork.plans import registry
from tarnwork.plans.relations import LI_SQL

from .test_queries import rows

for name in ("relations", "statistics", "mining", "sources", "further"):
    importlib.import_module(f"tarnwork.plans.{name}")
SF = "/root/testdata/sf0.01"

WHOLE = {
    "n2_hamming": "with a as (select s_suppkey as k, nullif(s_nationkey % 5, 2) as x, s_suppkey % 3 as y from supplier) select a.k as i, b.k as j, cast(case when a.x is null or b.x is null or a.x = b.x then 0 else 1 end + (a.y <> b.y)::int as double) as d from a join a b on a.k > b.k",
    "l27_consensus": "with r as (select run, s_suppkey as id, (s_suppkey * run) % 3 as c from supplier, (select unnest([1, 2, 3]) as run) where (s_suppkey + run) % 5 <> 0) select x.id as a, y.id as b, avg((x.c = y.c)::int::double) as share from r x join r y on x.run = y.run and x.id < y.id group by 1, 2",
    "f24_compatible_pairs": "with a as (select s_suppkey as k, nullif(s_nationkey % 4, 3) as x, nullif(s_suppkey % 3, 2) as y from supplier) select a.k as i, b.k as j from a join a b on a.k > b.k and (a.x is null or b.x is null or a.x = b.x) and (a.y is null or b.y is null or a.y = b.y)",
    "s21_k12_distance_file": "select a.s_suppkey as i, b.s_suppkey as j, round(abs(a.s_acctbal - b.s_acctbal), 4) as d from supplier a join supplier b on a.s_suppkey > b.s_suppkey",
    "u5_sort": "select o_orderkey, o_orderpriority, row_number() over (order by case o_orderstatus when 'P' then 1 when 'O' then 2 else 3 end, o_orderkey) as place from orders",
    "u6_data_sort": "select c_custkey, nullif(c_nationkey, 7) as nk from customer",
    "j2_right_join": "select c_custkey, n.k, n_name from (select c_custkey, nullif(c_nationkey, 7) as nk from customer) c right join (select nullif(n_nationkey, 5) as k, n_name from nation) n on c.nk = n.k",
    "f11_has_class": f"select l_orderkey, l_partkey, flag from {LI_SQL} where flag is not null",
    "f22_missing_rows": f"select l_orderkey, l_partkey from {LI_SQL} where tax is null",
    "t9_map_values": "select l_orderkey, l_partkey, case l_linenumber when 1 then 2 when 2 then 1 when 4 then 0 end as mapped from lineitem",
    "t10_t13_indicators": f"""select l_orderkey, l_partkey, case when flag is null then null when flag = 'A' then 1.0::double else -1.0::double end as "flag=A", case when flag is null then null when flag = 'R' then 1.0::double else -1.0::double end as "flag=R" from {LI_SQL}""",
}


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return db


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_table(spark, tables, name):
    assert rows(registry.QUERIES[name](spark, SF).toArrow()) == rows(tables.sql(WHOLE[name]).to_arrow_table())


def test_sorted_whole(spark, tables):
    assert [r.place for r in registry.QUERIES["u5_sort"](spark, SF).collect()] == list(range(1, tables.sql("select count(*) from orders").fetchall()[0][0] + 1))
    got = [(r.nk, r.c_custkey) for r in registry.QUERIES["u6_data_sort"](spark, SF).collect()]
    assert got == sorted(got, key=lambda x: (x[0] is not None, -(x[0] or 0), x[1])) and len(got) == tables.sql("select count(*) from customer").fetchall()[0][0]


def test_all_pairs_of_vectors(spark, tables):
    ids, x = (np.array(c) for c in zip(*tables.sql("select vec_id, embedding from embeddings order by 1").fetchall(), strict=True))
    r = np.corrcoef(x.astype(float))
    got = registry.QUERIES["n6_pearson_rows"](spark, SF).toPandas()
    assert len(got) == len(ids) * (len(ids) - 1) // 2 and (got.i > got.j).all() and not got.duplicated(["i", "j"]).any()
    assert np.allclose((1 - r[got.i, got.j]) / 2, got.d, atol=2e-6)
    got = registry.QUERIES["n5_dtw"](spark, SF).toPandas()
    assert len(got) == len(ids) * (len(ids) - 1) // 2 and (got.i > got.j).all() and not got.duplicated(["i", "j"]).any()
    for row in got.sample(30, random_state=1).itertuples():
        assert row.d == pytest.approx(D.dtw(x[row.i], x[row.j]))


def test_dtw_of_other_lengths(spark):
    made = [([1.0, 2.0, 3.0], [1.0, 3.0]), ([], [1.0]), ([0.0, 0.0, 5.0], [0.0, 5.0, 5.0]), ([2.0], [1.0, 1.0, 1.0]), ([4.0, 1.0], [1.0, 3.0])]
    df = spark.createDataFrame(made, "a array<double>, b array<double>")
    for row in df.select("a", "b", D.dtw_column(df.a, df.b).alias("d")).collect():
        assert row.d == pytest.approx(D.dtw(row.a, row.b))


def test_itemsets_of_any_size(spark, tables):
    from itertools import combinations

    from tarnwork.operators import associate as N

    baskets = [["o_orderstatus=" + a, "o_orderpriority=" + b, f"year={y}"] for a, b, y in tables.sql("select o_orderstatus, o_orderpriority, year(o_orderdate) from orders").fetchall()]
    counts = {}
    for basket in baskets:
        for size in (1, 2, 3):
            for x in combinations(sorted(basket), size):
                counts[x] = counts.get(x, 0) + 1
    want = {x: n for x, n in counts.items() if n >= 0.02 * len(baskets)}
    got = [(r.itemset, r["count"]) for r in registry.QUERIES["n13_itemsets"](spark, SF).collect()]
    assert sorted(got) == sorted((" ".join(x), n) for x, n in want.items())
    found = registry.QUERIES["n13_rules"](spark, SF).collect()
    rules = {(" ".join(y for y in x if y != right), right): n / want[tuple(y for y in x if y != right)] for x, n in want.items() if len(x) > 1 for right in x}
    rules = {k: c for k, c in rules.items() if c >= 0.2}
    assert {(r.left, r.right): r.confidence for r in found} == pytest.approx(rules, abs=1e-8) and len(found) == len(rules)
    five = spark.createDataFrame([(k, x) for k in range(3) for x in "abcde"], "key long, item string")
    assert N.itemsets(five, 0.5).count() == 31
    assert N.itemsets(five.limit(0), 0.5).count() == 0


def test_bounds_are_errors(spark, monkeypatch, tmp_path):
    from tarnwork.operators import relational as R
    from tarnwork.sources import readers, writers

    df = spark.createDataFrame([(k, float(k)) for k in range(3)], "k long, x double")
    assert len(writers.to_numpy(df, ["x"], 3)) == 3
    with pytest.raises(ValueError, match="more than 2 rows"):
        writers.to_numpy(df, ["x"], 2)
    monkeypatch.setattr(R, "MOST_LABELS", 3)
    assert R.transpose(df, ["x"], "k").columns == ["feature", "0", "1", "2"]
    monkeypatch.setattr(R, "MOST_LABELS", 2)
    with pytest.raises(ValueError, match="more than 2 labels"):
        R.transpose(df, ["x"], "k")
    (tmp_path / "a.net").write_text('*Vertices 2\n1 "a"\n2 "b"\n*Edges\n1 2\n')
    (tmp_path / "a.gml").write_text("graph [\nnode [ id 1 ]\nnode [ id 2 ]\nedge [ source 1 target 2 ]\n]\n")
    for read, name in ((readers.read_pajek, "a.net"), (readers.read_gml, "a.gml")):
        monkeypatch.setattr(readers, "MOST_LINES", 5)
        assert [x.count() for x in read(spark, str(tmp_path / name))] == [2, 1]
        monkeypatch.setattr(readers, "MOST_LINES", 4)
        with pytest.raises(ValueError, match="more than 4 lines"):
            read(spark, str(tmp_path / name))
