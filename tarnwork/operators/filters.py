"""Row predicates with explicit treatment of unknown values.

A condition is a Column of 1 (accept), 0 (reject) or NULL (no opinion). A conjunction rejects if any condition rejects,
a disjunction accepts if any accepts; without any opinion they accept and reject, respectively. All of it is Catalyst expressions,
so what the scan can evaluate is pushed down to it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-10


def _known(column: Column, test: Column, special: int) -> Column:
    """The test of known values; unknown ones give `special`: 1, 0, or -1 for no opinion."""
    other = F.lit(None).cast("int") if special < 0 else F.lit(special)
    return F.when(column.isNull(), other).otherwise(test.cast("int"))


def continuous(name: str, op: str, low: float, high: float | None = None, special: int = 0, tolerant: bool = False) -> Column:
    """op: = != < <= > >= between (closed) outside (open). Tolerant: equality up to a relative 1e-10."""
    x = F.col(name)
    slack = lambda v: abs(v) * TOLERANCE if tolerant else 0.0
    up = (lambda v: x - v <= slack(v)) if tolerant else (lambda v: x <= v)
    down = (lambda v: v - x <= slack(v)) if tolerant else (lambda v: x >= v)
    equal = (lambda v: F.abs(x - v) <= slack(v)) if tolerant else (lambda v: x == v)
    tests = {
        "=": lambda: equal(low), "!=": lambda: ~equal(low), "<": lambda: x < low, "<=": lambda: up(low), ">": lambda: x > low, ">=": lambda: down(low),
        "between": lambda: down(low) & up(high), "outside": lambda: (x < low) | (x > high),
    }
    return _known(x, tests[op](), special)


def discrete(name: str, values: Sequence[str], negate: bool = False, special: int = 0) -> Column:
    test = F.col(name).isin(*values)
    return _known(F.col(name), ~test if negate else test, (1 - special if negate and special >= 0 else special))


def string(name: str, op: str, low: str, high: str | None = None, case_sensitive: bool = True, special: int = 0) -> Column:
    """op: = != < <= > >= between outside contains not_contains begins ends; strings compare by their bytes."""
    x = F.col(name) if case_sensitive else F.lower(F.col(name))
    low, high = (low, high) if case_sensitive else (low.lower(), high and high.lower())
    tests = {
        "=": lambda: x == low, "!=": lambda: x != low, "<": lambda: x < low, "<=": lambda: x <= low, ">": lambda: x > low, ">=": lambda: x >= low,
        "between": lambda: (x >= low) & (x <= high), "outside": lambda: (x < low) | (x > high),
        "contains": lambda: x.contains(low), "not_contains": lambda: ~x.contains(low), "begins": lambda: x.startswith(low), "ends": lambda: x.endswith(low),
    }
    return _known(F.col(name), tests[op](), special)


def string_list(name: str, values: Sequence[str], case_sensitive: bool = True, special: int = 0) -> Column:
    x = F.col(name) if case_sensitive else F.lower(F.col(name))
    return _known(F.col(name), x.isin(*(v if case_sensitive else v.lower() for v in values)), special)


def same_value(name: str, value: object) -> Column:
    return F.col(name).eqNullSafe(F.lit(value)).cast("int")


def is_defined(*names: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in names)).cast("int")


def has_special(*names: str) -> Column:
    return reduce(lambda a, b: a | b, (F.col(n).isNull() for n in names)).cast("int")


def has_meta(map_column: str, name: str) -> Column:
    """Whether a row's sparse metas have an entry."""
    return F.map_contains_key(map_column, name).cast("int")


def same_example(row: dict[str, object]) -> Column:
    """Whole-row equality, unknown equal to unknown only."""
    return reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.lit(v)) for n, v in row.items())).cast("int")


def compatible(row: dict[str, object]) -> Column:
    """Whole-row compatibility: unknown goes with anything."""
    known = [(F.col(n).isNull() | (F.col(n) == F.lit(v))) for n, v in row.items() if v is not None]
    return reduce(lambda a, b: a & b, known, F.lit(True)).cast("int")


def compatible_pair(left: str, right: str, names: Sequence[str]) -> Column:
    """Compatibility of two aliased rows, to be used as a join condition."""
    pairs = ((F.col(f"{left}.{n}"), F.col(f"{right}.{n}")) for n in names)
    return reduce(lambda a, b: a & b, (a.isNull() | b.isNull() | (a == b) for a, b in pairs))


def conjunction(*conditions: Column, negate: bool = False) -> Column:
    whole = reduce(lambda a, b: a & b, (F.coalesce(c == 1, F.lit(True)) for c in conditions), F.lit(True))
    return (~whole if negate else whole).cast("int")


def disjunction(*conditions: Column, negate: bool = False) -> Column:
    whole = reduce(lambda a, b: a | b, (F.coalesce(c == 1, F.lit(False)) for c in conditions), F.lit(False))
    return (~whole if negate else whole).cast("int")


def negated(condition: Column) -> Column:
    return F.lit(1) - condition


def accepts(df: DataFrame, condition: Column, negate: bool = False) -> DataFrame:
    """Rows that a condition accepts (no opinion rejects)."""
    test = F.coalesce(condition == 1, F.lit(False))
    return df.where(~test if negate else test)


def mask(df: DataFrame, condition: Column, name: str = "selected") -> DataFrame:
    return df.withColumn(name, F.coalesce(condition == 1, F.lit(False)))


def count(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.count_if(F.coalesce(condition == 1, F.lit(False))).alias("accepted"))


def random(df: DataFrame, probability: float, order: Sequence[str], seed: int = 0) -> DataFrame:
    """Each row with the given probability, by its key."""
    from tarnwork.operators.sampling import uniform

    return df.where(uniform(order, seed) < probability)


def take(df: DataFrame, values: dict[str, Sequence[str]], conjunct: bool = True) -> DataFrame:
    return accepts(df, (conjunction if conjunct else disjunction)(*(discrete(n, v) for n, v in values.items())))


def drop(df: DataFrame, values: dict[str, Sequence[str]], conjunct: bool = True) -> DataFrame:
    return accepts(df, (conjunction if conjunct else disjunction)(*(discrete(n, v) for n, v in values.items())), negate=True)


def missing_summary(df: DataFrame, names: Sequence[str], class_name: str) -> DataFrame:
    """Whether any value, and any class, is unknown."""
    some = reduce(lambda a, b: a | b, (F.col(n).isNull() for n in names))
    return df.agg(F.coalesce(F.bool_or(some), F.lit(False)).alias("missing_values"), F.coalesce(F.bool_or(F.col(class_name).isNull()), F.lit(False)).alias("missing_classes"))
