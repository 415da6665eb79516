"""Typed columns with roles: what a table's columns mean, kept in the DataFrame's own schema metadata.

A column is discrete (with an ordered list of values), continuous or a string, and is a feature, the class, one of several
classes, a meta column or the row weight. Unknown values are NULL. A derived column is a Column expression, so
converting to another domain is one `select`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "tarnwork"
ROLES = ("feature", "class", "multiclass", "meta", "weight")


@dataclass(frozen=True)
class Variable:
    name: str
    kind: str = "continuous"  # or discrete, string
    role: str = "feature"
    values: tuple[str, ...] = ()
    ordered: bool = False
    compute: Callable[[DataFrame], Column] | None = field(default=None, compare=False)

    def metadata(self) -> dict[str, Any]:
        return {KEY: {"kind": self.kind, "role": self.role, "values": list(self.values), "ordered": self.ordered}}

    def column(self, df: DataFrame) -> Column:
        """This variable over a table: its own column, its derivation, or unknown."""
        if self.compute is not None:
            found = self.compute(df)
        elif self.name in df.columns:
            found = F.col(f"`{self.name}`")
        else:
            found = F.lit(None).cast("double" if self.kind == "continuous" else "string")
        return found.alias(self.name, metadata=self.metadata())

    def index(self, column: Column | None = None) -> Column:
        """Place of a discrete value in the list of values, from 0; unknown if not there."""
        place = F.array_position(F.array(*map(F.lit, self.values)), column if column is not None else F.col(f"`{self.name}`"))
        return F.when(place > 0, place - 1)


@dataclass(frozen=True)
class Domain:
    variables: tuple[Variable, ...]

    def of_role(self, *roles: str) -> list[Variable]:
        return [v for v in self.variables if v.role in roles]

    @property
    def features(self) -> list[Variable]:
        return self.of_role("feature")

    @property
    def class_var(self) -> Variable | None:
        return next(iter(self.of_role("class")), None)

    @property
    def metas(self) -> list[Variable]:
        return self.of_role("meta")

    def has_discrete(self, include_class: bool = False) -> bool:
        return any(v.kind == "discrete" for v in self.of_role("feature", *(["class"] if include_class else [])))

    def has_continuous(self, include_class: bool = False) -> bool:
        return any(v.kind == "continuous" for v in self.of_role("feature", *(["class"] if include_class else [])))

    def __getitem__(self, name: str) -> Variable:
        return next(v for v in self.variables if v.name == name)

    def merged(self, other: Domain) -> Domain:
        """Both domains' variables; variables of one name and kind are one, with the union of their values."""
        out = {v.name: v for v in self.variables}
        for v in other.variables:
            own = out.get(v.name)
            if own is not None and own.kind != v.kind:
                raise ValueError(f"{v.name} is {own.kind} in one domain and {v.kind} in the other")
            out[v.name] = v if own is None else Variable(v.name, v.kind, own.role, (*own.values, *(x for x in v.values if x not in own.values)), own.ordered, own.compute)
        return Domain(tuple(out.values()))


def domain_of(df: DataFrame) -> Domain:
    """The domain in the schema's metadata; columns without any are features by their type."""
    out = []
    for f in df.schema:
        about = (f.metadata or {}).get(KEY)
        if about:
            out.append(Variable(f.name, about["kind"], about["role"], tuple(about["values"]), about["ordered"]))
        else:
            kind = "continuous" if isinstance(f.dataType, (T.NumericType, T.TimestampType, T.DateType)) else "string" if isinstance(f.dataType, T.StringType) else "other"
            out.append(Variable(f.name, kind, "feature" if kind == "continuous" else "meta"))
    return Domain(tuple(out))


def with_roles(df: DataFrame, *, class_var: str | None = None, metas: Sequence[str] = (), weight: str | None = None, discrete: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Assign roles (and value lists of discrete columns); no row is touched."""
    out = []
    for v in domain_of(df).variables:
        role = "class" if v.name == class_var else "meta" if v.name in metas else "weight" if v.name == weight else "feature" if discrete and v.name in discrete else v.role
        kind, values = ("discrete", tuple(discrete[v.name])) if discrete and v.name in discrete else (v.kind, v.values)
        out.append(Variable(v.name, kind, role, values, v.ordered))
    return convert(df, Domain(tuple(out)))


def values_of(df: DataFrame, *columns: str) -> dict[str, list[str]]:
    """Sorted known values of each discrete column: one aggregation for all of them (value lists are small by nature)."""
    row = df.agg(*(F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c) for c in columns)).first()
    return {c: list(row[c]) for c in columns}


def convert(df: DataFrame, domain: Domain) -> DataFrame:
    """`df` in another domain: columns by name, derived ones computed, missing ones unknown."""
    return df.select(*(v.column(df) for v in domain.variables))


def pick_class(df: DataFrame, name: str | None) -> DataFrame:
    """Make one of several class columns the class, or none of them."""
    out = []
    for v in domain_of(df).variables:
        role = ("class" if v.name == name else "multiclass") if v.role in ("class", "multiclass") else v.role
        out.append(Variable(v.name, v.kind, role, v.values, v.ordered))
    return convert(df, Domain(tuple(out)))
