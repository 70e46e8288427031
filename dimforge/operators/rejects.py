"""Delimited records: those that can be loaded, and those that can't with the reason.

Records are assembled quote-aware and read by Python's strict csv reader, partition by partition;
structural errors are caught there, before any field is given a type. Times are read by the JVM
(:mod:`dimforge.operators.timestamps`), so Python only sees the text of the record.
"""

from __future__ import annotations

import csv
import io
import json
import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimforge.functions import yamlish
from dimforge.functions.names import col, free, require
from dimforge.operators import timestamps

_QUOTED = re.compile(r'(^|,)"(?:[^"]|"")*"(?=,|$)')
_WHOLE = re.compile(r"[+-]?[0-9]+")
_TRUE, _FALSE = {"1", "true"}, {"0", "false"}  # fixed values: how the files write a boolean


@dataclass(frozen=True)
class Field:
    """A field of the record: its name and kind (whole, boolean, mapping, time or text), blank allowed or not."""

    name: str
    kind: str = "text"
    required: bool = False


def assemble(raw: str) -> list[str] | None:
    """Logical records in `raw`: its physical lines, joined while a quote is open.

    None if a quote is still open at the end. A doubled quote inside quotes leaves the count even.
    """
    records, held = [], ""
    for line in io.StringIO(raw, newline=""):
        held += line
        if held.count('"') % 2 == 0:
            records.append(held)
            held = ""
    return None if held else records


def fields_of(raw: str) -> list[str] | None:
    """Fields of one record, or None if its quoting is broken.

    Broken: a quote left open, text beside a closing quote, a quote inside an unquoted field, or a
    line break outside quotes.
    """
    if "\n" in raw or "\r" in raw:
        records = assemble(raw)
        if records is None or len(records) != 1:
            return None
    try:
        rows = list(csv.reader((raw,), strict=True))
    except csv.Error:
        return None
    if len(rows) != 1 or not rows[0] or ('"' in raw and '"' in _QUOTED.sub(r"\1", raw)):
        return None
    return rows[0]


def whole_number(v: str) -> str | None:
    """`v` as plain digits with a sign if negative; None if it isn't a whole number of at most 64 bits, however long it is written."""
    if not _WHOLE.fullmatch(v):
        return None
    digits = v.lstrip("+-").lstrip("0") or "0"
    if len(digits) > 19 or int(digits) > 2**63 - (v[0] != "-"):
        return None
    return f"-{digits}" if v[0] == "-" and digits != "0" else digits


def typed(value: str, kind: str, wanted: bool = True) -> tuple[bool, str | None]:
    """Whether `value` fits `kind`, and its plain form: digits, true or false, JSON text (if `wanted`). Blank fits and gives null."""
    v = value.strip()
    if not v:
        return True, None
    if kind == "whole":
        n = whole_number(v)
        return n is not None, n
    if kind == "boolean":
        low = v.lower()
        return low in _TRUE or low in _FALSE, "true" if low in _TRUE else "false"
    if kind == "mapping" and not wanted:
        return yamlish.is_mapping(value), None
    if kind == "mapping":
        got = yamlish.mapping(value)
        return got is not None, json.dumps(got, ensure_ascii=False, default=str) if got is not None else None
    return True, value


def judge(raw: str | None, first: bool, fields: Sequence[Field], comment: str, wanted: Sequence[str] | None = None) -> tuple[bool, str | None, list[str | None]]:
    """(is it a record, reason it can't be loaded, plain forms of its fields) of one raw line; of mappings only those `wanted`, all for None."""
    none = [None] * len(fields)
    if raw is None:
        return False, None, none
    text = raw.removeprefix("﻿").removesuffix("\r")
    if first or not text.strip() or text.startswith(comment) or text == ",".join(f.name for f in fields):
        return False, None, none
    got = fields_of(text)
    if got is None:
        return True, "quoting", none
    if len(got) != len(fields):
        return True, "columns", none
    plain = []
    for f, v in zip(fields, got):
        ok, p = typed(v, f.kind, wanted is None or f.name in wanted)
        if not ok or (f.required and p is None):
            return True, f.name, none
        plain.append(p)
    return True, None, plain


def parse(lines: DataFrame, raw: str, fields: Sequence[Field], *, keep: Sequence[str] = (), line_no: str | None = None, comment: str = "#", wanted: Sequence[str] | None = None) -> DataFrame:
    """One row per record of `lines`: the `keep` columns, `reason` and the fields in plain form.

    Header (line number 1, or the field names themselves), comment and blank lines and nulls aren't
    records and don't appear. `reason` is null for a record that can be loaded, else the first that
    holds of `quoting`, `columns` and the names of unusable fields in order; the fields are then null.
    A leading byte-order mark and a final carriage return aren't part of a record. Whole numbers
    beyond 64 bits are unusable. Other columns of `lines` are not read. Records of any length are
    taken; nothing is shuffled. Mappings that aren't `wanted` (all are, for None) are checked but given as null.
    """
    require(lines, raw, *keep, *([line_no] if line_no else []))
    names = [f.name for f in fields]
    if set(names) & set(keep) or "reason" in [*names, *keep]:
        raise ValueError("field names, kept columns and `reason` must differ")
    r, first = free([*keep, *names], "__raw", "__first")
    source = lines.select(*[col(k) for k in keep], col(raw).alias(r), (F.coalesce(col(line_no) == 1, F.lit(False)) if line_no else F.lit(False)).alias(first))
    schema = source.drop(r, first).schema.add("reason", "string")
    for n in names:
        schema = schema.add(n, "string")
    kept, spec, want = len(keep), tuple(fields), None if wanted is None else frozenset(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for b in batches:
            judged = [judge(t, h, spec, comment, want) for t, h in zip(b.column(kept).to_pylist(), b.column(kept + 1).to_pylist())]
            at = pa.array([i for i, j in enumerate(judged) if j[0]], pa.int64())
            rows = [j for j in judged if j[0]]
            own = [b.column(i).take(at) for i in range(kept)]
            cols = [pa.array([j[1] for j in rows], pa.string()), *(pa.array([j[2][i] for j in rows], pa.string()) for i in range(len(spec)))]
            yield pa.RecordBatch.from_arrays([*own, *cols], names=[*b.schema.names[:kept], "reason", *names])

    out = source.mapInArrow(work, schema)
    for f in fields:
        if f.kind == "time":
            ok, us = free(out.columns, "__ok", f"{f.name}_us")
            out = timestamps.normalise(out, f.name, None, readable=ok, instant=us).drop(us)
            bad = F.col("reason").isNull() & col(f.name).isNotNull() & ~F.col(ok)
            out = out.withColumn("reason", F.when(bad, f.name).otherwise(F.col("reason"))).drop(ok)
    return out


def rejected(parsed: DataFrame) -> DataFrame:
    """The records set apart, without their fields."""
    return parsed.where("reason is not null")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is null").drop("reason")


def load(lines: DataFrame, raw: str, fields: Sequence[Field], *, zone: DataFrame | None = None, zone_key: str | None = None, keep: Sequence[str] = (), line_no: str | None = None, fail_fast: bool = False) -> DataFrame:
    """The loadable records with typed fields: whole bigint, boolean, mapping as JSON text, time as UTC timestamp.

    A time without a zone of its own is wall time in the zone that `zone` (key, zone name) gives for
    field `zone_key`; where that denotes no single instant the time is null. With `fail_fast` the
    first unusable record ends the run instead of being left out.
    """
    parsed = parse(lines, raw, fields, keep=keep, line_no=line_no)
    if fail_fast:
        parsed = parsed.withColumn("reason", F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit("unusable record: "), F.col("reason"))).cast("string")))
    good = accepted(parsed)
    z = None
    if zone is not None:
        (z,) = free(good.columns, "__zone")
        key, name = zone.columns
        small = zone.select(col(key).cast("string").alias("__k"), col(name).alias(z))
        good = good.join(small, col(zone_key) == F.col("__k"), "left").drop("__k")
    for f in fields:
        if f.kind == "time":
            ok, us = free(good.columns, "__ok", "__us")
            good = timestamps.normalise(good, f.name, z, readable=ok, instant=us).withColumn(f.name, F.timestamp_micros(F.col(us)).cast("timestamp_ntz")).drop(ok, us)
        elif f.kind == "whole":
            good = good.withColumn(f.name, col(f.name).cast("long"))
        elif f.kind == "boolean":
            good = good.withColumn(f.name, col(f.name) == "true")
    return good.drop(z) if z else good
