"""Declarative model of a warehouse: files, dimensions, facts, references, seed rows and maps.

The model is metadata only. Operators read it to decide what to join on, what to fill in and what to
call the result; data are DataFrames handed in beside it.
"""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from dimforge.schema import types

GRAINS = ("transaction", "hourly", "daily", "monthly")
SUFFIX = {"mini": "type", "one": "dimension", "two": "dimension", "four": "dimension", "date": "dimension", "ledger": "ledger", "stage": "stage", "table": "table"}
RESERVED = {
    "one": ("last_modified_at",), "date": ("last_modified_at",), "two": ("start_at", "end_at", "version", "last_modified_at"), "four": ("start_at", "end_at", "version", "last_modified_at"),
    "ledger": ("source_kind", "source_uuid", "start_at", "last_modified_at", "delta"), "fact": ("time_key", "last_modified_at"),
}
AGGREGATES = ("sum", "min", "max", "average")


@dataclass(frozen=True)
class Column:
    """A column; `default` is a value, or text ending in () that names a function."""

    name: str
    type: str = "integer"
    null: bool = False
    default: Any = None
    natural_key: bool = False
    surrogate_key: bool = False
    measure: bool = False
    aggregate: str | None = None
    partition: bool = False
    ignore: bool = False
    strict: bool = True
    auto: bool = False
    array: bool = False
    unique: tuple[str, ...] = ()
    values: tuple[str, ...] = ()

    def __post_init__(self):
        types.spark_type(self.type, self.array)
        if self.aggregate and self.aggregate not in AGGREGATES:
            raise ValueError(f"unknown aggregate {self.aggregate}")

    @property
    def required(self) -> bool:
        return not self.null and self.default is None and self.strict and not self.surrogate_key and self.type not in ("uuid", "sequence", "key_value", "json", "yaml")

    @property
    def in_natural_key(self) -> bool:
        return self.natural_key or bool(self.unique)

    def field(self) -> T.StructField:
        return T.StructField(self.name, types.spark_type(self.type, self.array), self.null, {"natural_key": self.natural_key, "measure": self.measure})


@dataclass(frozen=True)
class Reference:
    """A role-playing foreign key to `table`.

    `default` fills a missing key, `unknown` stands in for a member that isn't found (else the row is
    dropped from facts), `through` names references whose columns complete the key, `degenerate`
    passes the key through without a join, `implicit` says that what there is to know of the member stands in the row
    itself, `insert` creates members on the fly.
    """

    table: Table
    label: str | None = None
    insert: bool = False
    null: bool = False
    default: Any = None
    unknown: Any = None
    natural_key: bool = False
    multiple: bool = False
    denormalize: bool = True
    degenerate: bool = False
    implicit: bool = False
    through: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.label}_{self.table.name}" if self.label else self.table.name

    @property
    def alias(self) -> str:
        return f"{self.label}_{self.table.full_name}" if self.label else self.table.full_name

    @property
    def key(self) -> str:
        """Foreign key column: [label_]table_surrogate."""
        return f"{self.alias}_{self.table.surrogate}"


@dataclass(frozen=True)
class Row:
    """A seed row; `named` rows can be referred to, `default` is the row used when nothing is given."""

    values: dict[str, Any]
    named: str | None = None
    default: bool = False


@dataclass(frozen=True)
class Table:
    name: str
    kind: str = "table"
    columns: tuple[Column, ...] = ()
    references: tuple[Reference, ...] = ()
    rows: tuple[Row, ...] = ()
    grain: str | None = None
    partition: str | None = None

    def __post_init__(self):
        reserved = set(self.reserved)
        clash = reserved & {c.name for c in self.columns}
        if clash:
            raise ValueError(f"{self.name} contains reserved columns: {', '.join(sorted(clash))}")
        if self.grain and self.grain not in GRAINS:
            raise ValueError(f"unknown grain {self.grain}")
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names):
            raise ValueError(f"{self.name} has a column twice")

    @property
    def reserved(self) -> tuple[str, ...]:
        return RESERVED.get(self.kind, ())

    @property
    def full_name(self) -> str:
        if self.kind == "fact":
            return f"{self.name}_{self.grain}_fact" if self.grain else f"{self.name}_fact"
        if self.kind == "file":
            return f"{self.name}_file"
        return f"{self.name}_{SUFFIX[self.kind]}"

    @property
    def surrogate(self) -> str:
        return next((c.name for c in self.columns if c.surrogate_key), "id")

    @property
    def natural_keys(self) -> tuple[str, ...]:
        """Names of the natural key, foreign keys of key references included."""
        refs = tuple(r.key for r in self.references if r.natural_key)
        return refs + tuple(c.name for c in self.columns if c.in_natural_key)

    @property
    def attributes(self) -> tuple[str, ...]:
        """What describes a member: everything but keys, reserved and ignored columns."""
        keys = set(self.natural_keys)
        refs = tuple(r.key for r in self.references if not r.natural_key)
        return refs + tuple(c.name for c in self.columns if c.name not in keys and not c.surrogate_key and not c.ignore)

    @property
    def measures(self) -> tuple[Column, ...]:
        return tuple(c for c in self.columns if c.measure)

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    def ledger(self) -> Table:
        """The table of change events behind a type-four dimension: the same columns, none but keys required."""
        if self.kind != "four":
            raise ValueError(f"{self.name} has no ledger")
        relaxed = tuple(c if c.in_natural_key else replace(c, strict=False, null=True) for c in self.columns)
        return replace(self, kind="ledger", columns=relaxed, rows=())

    def schema(self) -> T.StructType:
        """Spark schema with generated columns: surrogate key, foreign keys, reserved columns."""
        out = []
        if self.kind in ("mini", "one", "two", "four", "date", "ledger", "table") and not any(c.surrogate_key for c in self.columns):
            out.append(T.StructField("id", T.LongType(), False))
        out += [T.StructField(r.key, T.LongType(), r.null) for r in self.references]
        out += [c.field() for c in self.columns]
        kinds = {"version": T.IntegerType(), "delta": T.IntegerType(), "time_key": T.LongType(), "source_kind": T.StringType(), "source_uuid": T.StringType()}
        out += [T.StructField(n, kinds.get(n, T.TimestampNTZType()), n == "end_at") for n in self.reserved]
        return T.StructType(out)

    def period_path(self, year: int, month: int) -> str:
        """Partition of a month, from the `partition` pattern (y%Ym%m)."""
        return (self.partition or "y%Ym%m").replace("%Y", f"{year:04d}").replace("%m", f"{month:02d}")

    def periods(self, start: dt.date, stop: dt.date) -> list[tuple[str, int, int]]:
        """The partitions from `start` to `stop`, both included: name, and the epoch seconds it begins with and ends before."""
        out, month = [], start.replace(day=1)
        while month <= stop:
            after = (month + dt.timedelta(days=32)).replace(day=1)
            out.append((self.period_path(month.year, month.month), *(calendar.timegm(d.timetuple()) for d in (month, after))))
            month = after
        return out

    def seed(self) -> list[dict[str, Any]]:
        """Seed rows, checked: unknown columns are errors, defaults are filled in."""
        known = {c.name: c for c in self.columns}
        out = []
        for r in self.rows:
            if extra := set(r.values) - set(known):
                raise ValueError(f"{self.name}: no columns {sorted(extra)}")
            full = {n: r.values.get(n, c.default) for n, c in known.items()}
            if missing := [n for n, c in known.items() if c.required and full[n] is None]:
                raise ValueError(f"{self.name}: row without {missing}")
            out.append(full)
        return out


@dataclass(frozen=True)
class Map:
    """A row function from a file to a table.

    `function` gets a dict (and the line number if `with_line`) and gives a dict, a list of dicts or
    None; `expressions` gives target columns as Spark expressions instead, which stay in the JVM.
    """

    source: Table
    target: Table
    function: Callable[..., Any] | None = None
    expressions: dict[str, Any] = field(default_factory=dict)
    distinct: bool = False
    fail_fast: bool = False
    with_line: bool = False


STORES = {
    "postgres": {"sep": ",", "header": True, "json": "quoted", "format": "csv"},
    "hive": {"sep": "\t", "header": False, "json": "raw", "format": "tsv"},
    "files": {"sep": None, "header": False, "json": "raw", "format": "raw"},
}


class Store:
    """Tables and files by name; the kind of store decides how its files are written."""

    def __init__(self, kind: str):
        if kind not in STORES:
            raise ValueError(f"unknown store {kind}")
        self.kind, self.options, self.tables, self.maps = kind, dict(STORES[kind]), {}, []

    def add(self, table: Table) -> Table:
        self.tables[table.full_name] = table
        if table.kind == "four":
            self.tables[table.ledger().full_name] = table.ledger()
        return table

    def __getattr__(self, name: str) -> Table:
        tables = self.__dict__.get("tables", {})
        if name in tables:
            return tables[name]
        raise AttributeError(f"no table {name}")

    def dimension(self, name: str, kind: str, columns=(), references=(), rows=(), grain: str | None = None) -> Table:
        return self.add(Table(name, kind, tuple(columns), tuple(references), tuple(rows), grain))

    def fact(self, name: str, columns=(), references=(), grains=("transaction",), partition: str | None = None) -> list[Table]:
        """One fact per grain."""
        return [self.add(Table(name, "fact", tuple(columns), tuple(references), (), g, partition)) for g in grains]

    def file(self, name: str, columns=()) -> Table:
        return self.add(Table(name, "file", tuple(columns)))

    def map(self, source: Table, target: Table, **kw: Any) -> Map:
        """A map to a type-four dimension fills its ledger."""
        m = Map(source, target.ledger() if target.kind == "four" else target, **kw)
        self.maps.append(m)
        return m

    def dereference(self, table: Table, dotted: str) -> tuple[Reference, Column]:
        """The reference and column that `label_name.column` in a file means."""
        ref, _, name = dotted.partition(".")
        for r in table.references:
            if r.name == ref and any(c.name == name for c in r.table.columns):
                return r, r.table.column(name)
        raise KeyError(f"dimension {dotted} not defined")


class Catalog:
    """Named stores."""

    def __init__(self, **kinds: str):
        self.stores = {n: Store(k) for n, k in kinds.items()}

    def __getattr__(self, name: str) -> Store:
        stores = self.__dict__.get("stores", {})
        if name in stores:
            return stores[name]
        raise AttributeError(f"no store {name}")


def order_by_dependency(depends: dict[str, list[str]]) -> list[str]:
    """Names so that each comes after those it depends on; a cycle is an error."""
    done: list[str] = []
    state: dict[str, int] = {}

    def visit(n: str) -> None:
        if state.get(n) == 1:
            raise ValueError(f"references depend on each other at {n}")
        if n not in state:
            state[n] = 1
            for d in depends.get(n, []):
                visit(d)
            state[n] = 2
            done.append(n)

    for n in depends:
        visit(n)
    return done
