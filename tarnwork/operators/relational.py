"""Projections, joins, unions, orderings and de-duplication over tables with unknown values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.session import pinned

#: A side that is broadcast without Spark's own estimate must be at most this many rows (checked by counting a limit).
BROADCAST_ROWS = 100_000


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the table is small by count; else the table as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """For work that is long for each row: a table of fewer partitions than there are cores is dealt to as many."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# -- projection ---------------------------------------------------------------------


def take_columns(df: DataFrame, which: Sequence[int | bool]) -> DataFrame:
    """Columns by index, or by a mask of booleans."""
    if which and all(isinstance(x, bool) for x in which):
        return df.select(*(c for c, keep in zip(df.columns, which, strict=True) if keep))
    return df.select(*(df.columns[i] for i in which))


def add_meta(df: DataFrame, name: str, value: float = 1.0) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "_no", start: int = 0) -> DataFrame:
    """Consecutive numbers in a total order, without one window over all rows.

    Rows are range-partitioned, sorted and written so (ranges are cut by a sample, another one at each run); partitions are counted, and each row
    adds its partition's offset; only one count per partition is gathered.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = pinned(df.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    local = parts.withColumn("_i", F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33))
    sizes = local.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_b", F.lit(0)).alias("_b"))
    return local.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_i") + start).drop("_p", "_m", "_i", "_b")


def running(df: DataFrame, order: Sequence[str | Column], sums: dict[str, str], groups: Sequence[str] = ()) -> DataFrame:
    """`df` with running totals, up to each row and with it, in an order that tells rows apart: {new column: summed column}, within groups.

    What range partitioning leaves in one partition, as it is small, goes through a plain window. Of more no window runs over all: rows are range-partitioned and written so, summed within their partition, and what the group has in the
    partitions before is added, of which there is a row per partition and group.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = pinned(df.repartitionByRange(*groups, *keys))
    if parts.rdd.getNumPartitions() == 1:
        whole = Window.partitionBy(*groups or [F.lit(0)]).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return parts.withColumns({n: F.sum(c).over(whole) for n, c in sums.items()}).select(*df.columns, *sums)
    parts = parts.withColumn("_p", F.spark_partition_id())
    here = Window.partitionBy("_p", *groups).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*groups or [F.lit(0)]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_p", *groups).agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    before = totals.select(F.col("_p").alias("_q"), *(F.col(g).alias(f"_g_{g}") for g in groups), *(F.sum(f"_t_{n}").over(earlier).alias(f"_b_{n}") for n in sums))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups), F.col("_p") == F.col("_q"))
    joined = parts.withColumns({n: F.sum(c).over(here) for n, c in sums.items()}).join(before, same)
    return joined.withColumns({n: F.col(n) + F.coalesce(f"_b_{n}", F.lit(0)) for n in sums}).select(*df.columns, *sums)


def add_row_id(df: DataFrame, order: Sequence[str], start: int = 0, name: str = "row_id") -> DataFrame:
    """A string id per row, in the order of a unique key."""
    return numbered(df, order, name, start).withColumn(name, F.col(name).cast("string"))


def add_range(df: DataFrame, order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """A number per row, from `start` on, in the order of a unique key."""
    return numbered(df, order, name, start)


def add_uuid(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.uuid())


def hstack(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Positional zip of tables of equal length; shared columns must agree where both are known, and fill each other's unknowns."""
    shared = [c for c in left.columns if c in right.columns]
    a, b = numbered(left, left_order).alias("a"), numbered(right, right_order).alias("b")
    same = [F.assert_true(F.col(f"a.{c}").isNull() | F.col(f"b.{c}").isNull() | (F.col(f"a.{c}") == F.col(f"b.{c}")), f"{c} differs") for c in shared]
    checked = reduce(lambda p, q: F.coalesce(p, q), same, F.lit(None).cast("void"))
    joined = a.join(b, F.col("a._no") == F.col("b._no"), "full")
    out = [F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) if c in shared else F.col(f"a.{c}") for c in left.columns]
    return joined.where(checked.isNull() & F.assert_true(F.col("a._no").isNotNull() & F.col("b._no").isNotNull(), "lengths differ").isNull()).select(*out, *(F.col(f"b.{c}") for c in right.columns if c not in shared))


def construct(df: DataFrame, definitions: dict[str, str]) -> DataFrame:
    """New columns from SQL expressions, which may use each other in any acyclic order."""
    todo = dict(definitions)
    while todo:
        names = {n: set(e.replace("(", " ").replace(")", " ").replace(",", " ").replace("*", " ").replace("+", " ").replace("-", " ").replace("/", " ").split()) for n, e in todo.items()}
        ready = [n for n in todo if not names[n] & (todo.keys() - {n}) and n not in names[n] - set(df.columns)]
        if not ready:
            raise ValueError(f"definitions use each other in a circle: {', '.join(todo)}")
        df = df.withColumns({n: F.expr(todo.pop(n)) for n in ready})
    return df


def log_transform(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Natural logarithm, unknown where not positive."""
    return df.withColumns({n: F.when(F.col(n) > 0, F.ln(n)) for n in names})


def edit_domain(df: DataFrame, rename: dict[str, str], values: dict[str, dict[str, str]]) -> DataFrame:
    """Rename columns, and values of discrete ones."""
    for name, mapping in values.items():
        df = df.withColumn(name, F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)), F.col(name)), F.col(name)))
    return df.withColumnsRenamed(rename)


def value_weights(df: DataFrame, names: Sequence[str], weight: Column | None = None) -> DataFrame:
    """(attribute, value, weight) of all listed columns in one scan; unknown values are left out."""
    w = weight if weight is not None else F.lit(1.0)
    long = df.select(w.alias("_w"), *(F.col(n).cast("string").alias(n) for n in names)).unpivot("_w", list(names), "attribute", "value")
    return long.where("value is not null").groupBy("attribute", "value").agg(F.sum("_w").alias("weight"))


def used_values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return value_weights(df, names).where("weight > 1e-20").groupBy("attribute").agg(F.array_join(F.sort_array(F.collect_set("value")), ",").alias("used"), F.count("*").alias("n"))


def without_single_valued(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop listed columns that have one value or none."""
    row = df.agg(*(F.count_distinct(n).alias(n) for n in names)).first()
    return df.drop(*(n for n in names if row[n] < 2))


#: Labels that `transpose` makes columns of; more are an error.
MOST_LABELS = 10_000


def transpose(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Continuous columns become rows, named by `feature`; rows become columns, named by `label` (a bounded number of them)."""
    names = [str(r[0]) for r in df.select(label).distinct().orderBy(label).limit(MOST_LABELS + 1).collect()]
    if len(names) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels to transpose")
    return df.select(F.col(label).cast("string").alias("_l"), *columns).unpivot("_l", list(columns), "feature", "value").groupBy("feature").pivot("_l", names).agg(F.first("value"))


# -- joins --------------------------------------------------------------------------------


def equi_join(left: DataFrame, right: DataFrame, on_left: Sequence[str], on_right: Sequence[str], how: str = "left") -> DataFrame:
    """Outer join on equal keys, unknown keys matching nothing; columns that both have are merged (the driving side first)."""
    a, b = left.alias("a"), right.alias("b")
    keys = reduce(lambda p, q: p & q, (F.col(f"a.{x}") == F.col(f"b.{y}") for x, y in zip(on_left, on_right, strict=True)))
    order = ("a", "b") if how == "left" else ("b", "a")
    shared = set(left.columns) & set(right.columns)
    out = [F.coalesce(*(F.col(f"{s}.{c}") for s in order)).alias(c) if c in shared else F.col(f"a.{c}") for c in left.columns]
    return a.join(b, keys, how).select(*out, *(F.col(f"b.{c}") for c in right.columns if c not in shared))


def lookup_join(left: DataFrame, right: DataFrame, on_left: Sequence[str], on_right: Sequence[str], order: Sequence[str], unknown_matches: bool = False) -> DataFrame:
    """Each left row with the first right row (by `order`) of its key, so rows never multiply. Only new columns are added."""
    new = [c for c in right.columns if c not in left.columns]
    first = right.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(on_right))).agg(F.min_by(F.struct(*new), F.struct(*order)).alias("_r"))
    same = (lambda x, y: x.eqNullSafe(y)) if unknown_matches else (lambda x, y: x == y)
    keys = reduce(lambda p, q: p & q, (same(F.col(c), F.col(f"_k{i}")) for i, c in enumerate(on_left)))
    return left.join(first, keys, "left").select(*left.columns, *(F.col(f"_r.{c}").alias(c) for c in new))


def pairs_below(df: DataFrame, key: str, block: str | None = None) -> DataFrame:
    """All pairs of rows with a.key > b.key: of a block where given (an equi-join), else of a table meant to be small."""
    a, b = df.alias("a"), df.alias("b")
    test = F.col(f"a.{key}") > F.col(f"b.{key}")
    return a.join(b, (F.col(f"a.{block}") == F.col(f"b.{block}")) & test if block else test)


def cartesian_feature(df: DataFrame, names: Sequence[str], out: str) -> DataFrame:
    """The product of discrete columns as one; unknown if any is."""
    known = reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in names))
    return df.withColumn(out, F.when(known, F.concat_ws("-", *(F.col(n).cast("string") for n in names))))


# -- sets, order, limits --------------------------------------------------------------------


def vstack(*tables: DataFrame) -> DataFrame:
    """Bag union in the first table's domain."""
    first = tables[0]
    return reduce(lambda a, b: a.unionByName(b.select(*(c for c in b.columns if c in first.columns)), allowMissingColumns=True), tables)


def concatenate(tables: dict[str, DataFrame], union: bool = True, source: str | None = None) -> DataFrame:
    """Union or intersection of the tables' columns, with an optional source column."""
    common = reduce(lambda a, b: [c for c in a if c in b], (t.columns for t in tables.values()))
    parts = [(t if union else t.select(*common)) for t in tables.values()]
    parts = [p.withColumn(source, F.lit(n)) if source else p for n, p in zip(tables, parts, strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def remove_duplicates(df: DataFrame, names: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Rows equal in the listed columns (unknown equal to unknown) once, with their weights' sum."""
    return df.groupBy(*names).agg(F.sum(weight if weight is not None else F.lit(1.0)).alias("weight"))


def sorted_by(df: DataFrame, names: Sequence[str], descending: Sequence[bool] | None = None, values: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Unknown last (first where descending); discrete columns by the place of their value."""
    def key(n: str) -> Column:
        return F.array_position(F.array(*map(F.lit, values[n])), F.col(n)) if values and n in values else F.col(n)

    flags = descending or [False] * len(names)
    return df.orderBy(*(key(n).desc_nulls_first() if d else key(n).asc_nulls_last() for n, d in zip(names, flags, strict=True)))


def shuffle_columns(df: DataFrame, names: Sequence[str], order: Sequence[str], seed: int = 0) -> DataFrame:
    """Permute each listed column's values on its own."""
    from tarnwork.operators.sampling import uniform

    out = numbered(df, order, "_row")
    for k, n in enumerate(names):
        mixed = numbered(df.select(F.col(n).alias(f"_v{k}"), uniform(order, seed + k).alias("_h"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order))), ["_h", *(f"_o{i}" for i in range(len(order)))], "_row").select("_row", f"_v{k}")
        out = out.join(mixed, "_row").withColumn(n, F.col(f"_v{k}")).drop(f"_v{k}")
    return out.drop("_row")


def get_items(df: DataFrame, indices: Sequence[int], order: Sequence[str]) -> DataFrame:
    """Rows by position, repeats allowed, with the place in `indices` as `item`."""
    wanted = df.sparkSession.createDataFrame([(k, i) for k, i in enumerate(indices)], "item long, _at long")
    return numbered(df, order).join(F.broadcast(wanted), F.col("_no") == F.col("_at")).drop("_no", "_at")


def top(df: DataFrame, by: str, n: int, ties: Sequence[str]) -> DataFrame:
    """The n largest: a bounded heap per task, never a full sort."""
    return df.orderBy(F.col(by).desc(), *ties).limit(n)


def average_tables(tables: Sequence[DataFrame], key: str, continuous: Sequence[str], discrete: Sequence[str]) -> DataFrame:
    """Element-wise mean of two tables, median of three or more; discrete columns from the first."""
    parts = reduce(lambda a, b: a.unionByName(b), (t.select(key, *continuous, *discrete, F.lit(k).alias("_t")) for k, t in enumerate(tables)))
    middle = F.avg if len(tables) < 3 else F.median
    return parts.groupBy(key).agg(*(middle(c).alias(c) for c in continuous), *(F.min_by(c, "_t").alias(c) for c in discrete))
