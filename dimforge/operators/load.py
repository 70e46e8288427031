"""From the model to plans: loading dimensions and facts whose files name references by dotted columns.

A file column `state.name` is column `name` of the member that reference `state` points to; a label
comes first (`hr_state.name`). Which columns to join on, what to fill in and what to call the keys
all follow from the model.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimforge.functions.merge import json_to_map
from dimforge.functions.names import col
from dimforge.operators import dimensions, facts, keys
from dimforge.operators.dimensions import Lookup
from dimforge.operators.facts import Member
from dimforge.schema.model import Reference, Table

Members = Mapping[str, DataFrame]


def _key_columns(ref: Reference, have: list[str]) -> dict[str, str]:
    """Natural key columns of a reference's members, and the file columns that give them.

    Those the file doesn't name under the reference are taken from a column of the same name in the row
    (a tenant, say), if there is one.
    """
    out = {}
    for c in ref.table.columns:
        if c.in_natural_key and not c.auto:
            dotted = f"{ref.name}.{c.name}"
            if dotted in have:
                out[c.name] = dotted
            elif c.name in have:
                out[c.name] = c.name
    return out


def insert_missing_members(rows: DataFrame, target: Table, members: Members) -> dict[str, DataFrame]:
    """`members` with those added that `rows` name through references declared with insert.

    Null keys are filled with the column's default; where there is none they name no member.
    """
    out = dict(members)
    for ref in target.references:
        on = _key_columns(ref, rows.columns)
        if not ref.insert or not on or ref.degenerate or ref.implicit:
            continue
        plain = {n: c.default for n, c in ((c.name, c) for c in ref.table.columns) if n in on and c.default is not None and not str(c.default).endswith("()")}
        optional = [c.name for c in ref.table.columns if c.name in on and c.null]
        name = ref.table.full_name
        out[name] = dimensions.insert_references(out[name], rows, on, defaults=plain, optional=optional, key=ref.table.surrogate)
    return out


def stage_rows(rows: DataFrame, target: Table, members: Members) -> DataFrame:
    """`rows` with references turned into surrogate keys (null where nothing matches) and JSON into maps."""
    lookups = []
    for ref in target.references:
        on = _key_columns(ref, rows.columns)
        if on:
            default = {c.name: c.default for c in ref.table.columns}
            filled = {m: F.coalesce(col(s), F.lit(default[m])) if default.get(m) is not None and not str(default[m]).endswith("()") else s for m, s in on.items()}
            lookups.append(Lookup(ref.key, members[ref.table.full_name], filled, ref.table.surrogate))
    own = [c.name for c in target.columns if c.name in rows.columns and not c.surrogate_key]
    reserved = [n for n in target.reserved if n in rows.columns]
    staged = dimensions.stage(rows, lookups, [*own, *reserved])
    for c in target.columns:
        if c.type == "key_value" and c.name in own and dict(rows.dtypes)[c.name] == "string":
            staged = staged.withColumn(c.name, json_to_map(col(c.name)))
    return staged


def load_dimension(rows: DataFrame, target: Table, members: Members, existing: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(the dimension after the load, the members of all references after it).

    A type-four dimension is loaded into its ledger. Rows with the key of one that is there update what
    isn't null in them; others are added and get the next surrogate keys. Reserved columns of existing
    rows are left alone.
    """
    goal = target.ledger() if target.kind == "four" else target
    after = insert_missing_members(rows, goal, members)
    staged = stage_rows(rows, goal, after)
    key = [*goal.natural_keys]
    if goal.kind == "ledger":
        key += ["source_kind", "source_uuid", "start_at"]
    elif goal.kind in ("two", "four"):
        key += ["start_at"]
    key = [k for k in dict.fromkeys(key) if k in staged.columns]
    update = [a for a in goal.attributes if a in staged.columns]
    merged = dimensions.upsert(existing.drop(goal.surrogate), staged.select(*[col(c) for c in staged.columns if c in existing.columns]), key, update)
    known = existing.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(key)], col(goal.surrogate).alias("__id"))
    on = F.lit(True)
    for i, k in enumerate(key):
        on = on & col(k).eqNullSafe(F.col(f"__k{i}"))
    placed = merged.join(known, on, "left").drop(*[f"__k{i}" for i in range(len(key))])
    old = placed.where("__id is not null").select(F.col("__id").alias(goal.surrogate), *[col(c) for c in merged.columns])
    new = keys.assign(placed.where("__id is null").drop("__id"), key, existing, goal.surrogate)
    return old.unionByName(new), after


def fact_members(rows: DataFrame, target: Table, members: Members, sequential: Sequence[str] = ()) -> list[Member]:
    """The references of a fact as :class:`~dimforge.operators.facts.Member`, in the order they are declared."""
    out = []
    labels = {ref.name: ref for ref in target.references}
    for ref in target.references:
        on = _key_columns(ref, rows.columns)
        if ref.degenerate:
            first = next(iter(on.values()), None) or next((c for c in rows.columns if c.startswith(f"{ref.name}.")), ref.key)
            out.append(Member(ref.key, on={"": first}, name=ref.name, degenerate=True))
            continue
        through: dict[str, list[tuple[str, str]]] = {}
        for other in ref.through:
            for c in labels[other].table.columns:
                if c.name in on and c.in_natural_key:
                    through.setdefault(c.name, []).append((other, c.name))
        default: dict[str, Any] = {}
        row = next((r.values for r in ref.table.rows if r.default), {}) if ref.default is True else ref.default if isinstance(ref.default, dict) else {}
        for c in ref.table.columns:
            if c.name in on:
                if c.name in row:
                    default[c.name] = row[c.name]
                elif c.default is not None and not str(c.default).endswith("()"):
                    default[c.name] = c.default
        constant = {c.name: c.default for c in ref.table.columns if c.auto and c.default is not None}
        out.append(Member(ref.key, members[ref.table.full_name], on, ref.name, ref.table.surrogate, default, through, constant, ref.unknown, ref.table.kind in ("two", "four"), sequential=ref.name in sequential))
    return out


def load_fact(rows: DataFrame, target: Table, members: Members, *, sequential: Sequence[str] = ()) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(staged facts with keys, measures, time_key and period, the members after it).

    `sequential` names references to relabelled histories, see :class:`~dimforge.operators.facts.Member`.
    """
    after = insert_missing_members(rows, target, members)
    keep = [c.name for c in target.columns if c.name in rows.columns]
    staged = facts.stage_fact(rows, fact_members(rows, target, after, sequential), time_key="time_key", keep=[*keep, "time_key"])
    return facts.with_period(staged), after


def rollup(fact: DataFrame, source: Table, target: Table, *, date: str, members: DataFrame | None = None) -> DataFrame:
    """`fact` (of table `source`) at the grain of `target`: by its references, measures as declared.

    Columns are matched by name. A measure without an aggregate can't be rolled up.
    """
    bare = [m.name for m in source.measures if m.aggregate is None]
    if bare:
        raise ValueError(f"measures without an aggregate: {bare}")
    refs = [r.key for r in target.references if r.key in fact.columns and r.name != date]
    key = next(r for r in source.references if r.name == date)
    surrogate = key.table.surrogate
    natural = next((c.name for c in key.table.columns if c.in_natural_key), "date_id")
    return facts.rollup(fact, grain=target.grain or "daily", date_key=key.key, keys=refs, measures={m.name: m.aggregate for m in source.measures}, members=members, member_key=surrogate, member_date=natural)


def denormalize(table: DataFrame, model: Table, members: Members, *, order: list[str] | None = None, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """`table` with its references written out as label_name_column, and its own columns."""

    def joins(t: Table, prefix: str) -> list[dimensions.Join]:
        out = []
        for r in t.references:
            if r.degenerate or r.implicit or not r.denormalize:
                continue
            shown = {f"{prefix}{r.alias}_{c.name}": c.name for c in r.table.columns if c.in_natural_key and not c.ignore and not c.auto}
            out.append(dimensions.Join(r.key, members[r.table.full_name], shown, r.table.surrogate, tuple(joins(r.table, f"{prefix}{r.alias}_")) if all(x.key in members[r.table.full_name].columns for x in r.table.references) else ()))
        return out

    own = [r.key for r in model.references if r.degenerate and r.key in table.columns]
    own += [n for r in model.references if r.implicit for c in r.table.columns if c.in_natural_key and (n := f"{r.alias}_{c.name}") in table.columns]
    own += [c.name for c in model.columns if not c.ignore and not c.surrogate_key and c.name in table.columns]
    own += [n for n in model.reserved if n in table.columns]
    return dimensions.denormalize(table, joins(model, ""), own, order=order, include=include, exclude=exclude)
