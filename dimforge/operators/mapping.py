"""Row maps from files to tables, and checks of tables against their declarations."""

from __future__ import annotations

import contextlib
import itertools
import json
import os
import subprocess
import threading
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimforge.functions.names import col, free, require
from dimforge.schema import types
from dimforge.schema.model import Column as Declared
from dimforge.schema.model import Map, Table


def project(source: DataFrame, expressions: dict[str, Column], *, distinct: bool = False) -> DataFrame:
    """Map by expressions: stays in the JVM. An expression that gives an array of structs is a fan-out, see :func:`fan_out`."""
    out = source.select(*[e.alias(n) for n, e in expressions.items()])
    return out.distinct() if distinct else out


def fan_out(source: DataFrame, rows: Column, keep: Sequence[str] = ()) -> DataFrame:
    """One output row per struct in the array `rows`; none for an empty or null array."""
    (r,) = free(source.columns, "__row")
    return source.select(*[col(c) for c in keep], F.explode(rows).alias(r)).select(*[col(c) for c in keep], F.col(f"{r}.*"))


def apply(source: DataFrame, function: Callable[..., Any], schema: T.StructType, *, distinct: bool = False, line: str | None = None) -> DataFrame:
    """Map by a Python function, batch by batch: a dict, a list of dicts or None for each row.

    The function gets the row as a dict, and the value of column `line` second if that is named.
    Values are made text here and coerced afterwards by :func:`coerced`. A row for which the function
    fails comes out with the error in `error` and nothing else. Whole rows repeated are left out with `distinct`.
    """
    names = [f.name for f in schema.fields]
    out = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("error", T.StringType())])

    def text(v: Any) -> str | None:
        return None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[tuple] = []
            for row in b.to_pylist():
                try:
                    r = function(row, row[line]) if line else function(row)
                    for x in r if isinstance(r, list) else [] if r is None else [r]:
                        got.append((*[text(x.get(n)) for n in names], None))
                except Exception as e:  # noqa: BLE001 - any failure of the caller's function rejects the row
                    got.append((*[None] * len(names), f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.string()) for i in range(len(names) + 1)], names=[*names, "error"])

    mapped = source.mapInArrow(work, out)
    return mapped.distinct() if distinct else mapped


def pipe(lines: DataFrame, column: str, command: Sequence[str], *, env: dict[str, str] | None = None) -> DataFrame:
    """Text lines through an external program, one process per partition: what it prints, line by line, as `line`.

    The program is started without a shell and must be on every executor; its standard input is the partition's
    lines, its errors go to the executor's log. A failing program fails the task. Nulls aren't given to it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = subprocess.Popen(list(command), stdin=subprocess.PIPE, stdout=subprocess.PIPE, env={**os.environ, **(env or {})}, encoding="utf-8", errors="replace")

        def feed() -> None:
            with contextlib.suppress(BrokenPipeError), p.stdin:
                for b in batches:
                    p.stdin.writelines(f"{t}\n" for t in b.column(0).to_pylist() if t is not None)

        feeder = threading.Thread(target=feed, daemon=True)
        feeder.start()
        while part := list(itertools.islice(p.stdout, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([x.removesuffix("\n") for x in part], pa.string())], names=["line"])
        feeder.join()
        if p.wait():
            raise RuntimeError(f"{command[0]} ended with {p.returncode}")

    return lines.select(col(column)).mapInArrow(work, "line string")


def coerced(rows: DataFrame, table: Table, keep: Sequence[str] = ()) -> DataFrame:
    """`rows` of text as `table`'s types, with `reject`: the reason a row can't be in the table, null if it can.

    Text that isn't blank but gives no value of its type, and a null where the table requires a value,
    are reasons: malformed JSON, YAML and lists too. Defaults, functions among them, are filled in first; columns the table doesn't declare
    are dropped, but for those to `keep`.
    """
    out, reasons = [], []
    for c in table.columns:
        raw = col(c.name) if c.name in rows.columns else F.lit(None).cast("string")
        v = types.coerce(raw, c.type, c.array, c.values)
        reasons.append(F.when((F.trim(raw.cast("string")) != "") & v.isNull(), F.lit(f"could not coerce {c.name}")))
        if c.default is not None:
            v = F.coalesce(v, types.default_value(c.default, c.type, c.array))
        if c.required:
            reasons.append(F.when(v.isNull(), F.lit(f"missing {c.name}")))
        out.append(v.alias(c.name))
    failed = col("error") if "error" in rows.columns and "error" not in {c.name for c in table.columns} else F.lit(None).cast("string")
    return rows.select(*out, *[col(k) for k in keep], F.coalesce(failed, *reasons, F.lit(None).cast("string")).alias("reject"))


def split(checked: DataFrame, *, fail_fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with the reason); with `fail_fast` reading the good rows fails at the first reject."""
    bad = checked.where("reject is not null")
    if fail_fast:
        checked = checked.withColumn("reject", F.when(F.col("reject").isNotNull(), F.raise_error(F.col("reject")).cast("string")))
    return checked.where("reject is null").drop("reject"), bad


def output_table(m: Map) -> Table:
    """The columns a map gives, with their types: those its expressions name, or all that its target can take.

    A target takes its own columns, what has to be known of the members its references point to (as reference.column), and
    reserved columns that a load may set.
    """
    own = {c.name: c for c in m.target.columns if not c.surrogate_key and not c.ignore}
    for ref in m.target.references:
        for c in ref.table.columns:
            if c.in_natural_key and not c.auto:
                own[f"{ref.name}.{c.name}"] = replace(c, name=f"{ref.name}.{c.name}", null=ref.null or ref.default is not None or c.null, natural_key=False, unique=())
    kinds = {"start_at": "timestamp", "last_modified_at": "timestamp", "delta": "integer", "source_kind": "string", "source_uuid": "string", "time_key": "long"}
    own |= {n: Declared(n, kinds[n], null=True) for n in m.target.reserved if n in kinds}
    names = list(m.expressions) or list(own)
    if unknown := [n for n in names if n not in own]:
        raise ValueError(f"{m.target.name} takes no {', '.join(unknown)}")
    return Table(m.target.name, "file", tuple(own[n] for n in names))


def run_map(m: Map, rows: DataFrame, *, line: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(what the map makes of `rows`, typed for its target; the rows and outputs set apart, with the reason in `reject`).

    `rows` are text as a file has it. They are coerced to the map's source first; what fails there, what the function
    fails for and what the target can't take is set apart, or with the map's `fail_fast` ends the run. `line` names
    the column with the line number, for maps `with_line`. Whole rows repeated are left out with `distinct`.
    """
    if m.with_line and line is None:
        raise ValueError("this map needs the line number")
    out = output_table(m)
    read = coerced(rows, m.source, keep=[line] if m.with_line else [])
    good, bad = split(read, fail_fast=m.fail_fast)
    if m.function is None:
        made = project(good, m.expressions or {c.name: col(c.name) for c in out.columns if c.name in good.columns})
    else:
        schema = T.StructType([T.StructField(c.name, T.StringType()) for c in out.columns])
        made = apply(good, m.function, schema, line=line if m.with_line else None)
    kept, refused = split(coerced(made, out), fail_fast=m.fail_fast)
    text = lambda df: df.select(F.to_json(F.struct(*[col(c) for c in df.columns if c != "reject"])).alias("row"), "reject")
    return kept.distinct() if m.distinct else kept, text(bad).unionByName(text(refused))


# ------------------------------------------------------------------------------------------- audits


def missing_parents(child: DataFrame, key: str | Sequence[str], parent: DataFrame, parent_key: str | Sequence[str]) -> DataFrame:
    """Rows whose `key` no parent has: what a foreign key would refuse. A key of several columns counts if none of them is null."""
    keys, theirs = ([x] if isinstance(x, str) else list(x) for x in (key, parent_key))
    require(child, *keys)
    p = parent.select(*[col(k).alias(f"__pk{i}") for i, k in enumerate(theirs)])
    on, whole = F.lit(True), F.lit(True)
    for i, k in enumerate(keys):
        on, whole = on & (col(k) == F.col(f"__pk{i}")), whole & col(k).isNotNull()
    return child.where(whole).join(p, on, "left_anti")


def duplicates(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of `columns`, none null, that several rows have, and how many: what a unique constraint would refuse."""
    some = table.dropna(subset=list(columns))
    return some.groupBy(*[col(c) for c in columns]).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def outside(table: DataFrame, column: str, values: Sequence[Any]) -> DataFrame:
    """Values of an enumeration that aren't declared, and how often they occur."""
    return table.where(col(column).isNotNull() & ~col(column).isin(*values)).groupBy(col(column)).agg(F.count(F.lit(1)).alias("n_rows"))


def seed(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`table` with those seed rows whose keys it doesn't have; running again adds nothing."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"s.`{k}`").eqNullSafe(F.col(f"t.`{k}`"))
    new = rows.alias("s").join(table.alias("t"), on, "left_anti")
    return table.unionByName(new, allowMissingColumns=True)


def freshness(table: DataFrame, column: str = "last_modified_at") -> DataFrame:
    """One row: the latest `column`, cut to the minute."""
    return table.agg(F.date_trunc("minute", F.max(col(column))).cast("timestamp_ntz").alias("last_modified_at"))


def statistics(table: DataFrame) -> DataFrame:
    """One row per column that can be ordered: `column`, `n_rows`, `n_null`, about how many distinct values, `least` and `greatest` as text.

    One pass, combined on the map side; maps and the like are left out.
    """
    names = [n for n, k in table.dtypes if not any(x in k for x in ("map<", "variant", "array<", "struct<"))]
    if not names:
        raise ValueError("no column can be ordered")
    got = table.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.count_if(col(c).isNull()), F.approx_count_distinct(col(c)), F.min(col(c)).cast("string"), F.max(col(c)).cast("string")).alias(f"s{i}") for i, c in enumerate(names)])
    part = lambda i: [F.col(f"s{i}")[f"col{j}"].alias(n) for j, n in enumerate(("n_null", "n_distinct", "least", "greatest"), 1)]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), *part(i)) for i, c in enumerate(names)])
    return got.select(F.explode(rows).alias("r")).select("r.*")
