"""Dimensions: references, staging, upsert, ledger to history, denormalizing.

Null and repeated rows, empty tables and extra columns are taken as each function says; nothing here
reads data to decide on a plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dimforge.functions.merge import comparable
from dimforge.functions.names import col, free, require
from dimforge.operators import keys as surrogate
from dimforge.operators.history import _bucketed
from dimforge.operators.scan import LARGE, by_size, running

UNIT = {"hourly": "hour", "daily": "day", "monthly": "month"}


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None, newest: Sequence[str] = ()) -> DataFrame:
    """`target` with `source` merged in: matching rows get each of `update` that isn't null in the source, others are added.

    `update` None means every shared column but the keys. Rows match when all keys are equal; a null key
    equals nothing, so such rows are added. Several source rows with one key count as the greatest of
    them, by the source columns `newest` first. Columns only the target has are kept, and null in added rows; columns only the source has are
    dropped.
    """
    require(target, *keys)
    require(source, *keys)
    shared = [c for c in target.columns if c in source.columns and c not in keys]
    update = shared if update is None else [c for c in update if c in shared]
    maps = [c for c in shared if dict(source.dtypes)[c].startswith("map<")]
    plain = [c for c in shared if c not in maps]
    require(source, *newest)
    first = [col(c).alias(f"__newest{i}") for i, c in enumerate(newest)]
    rank = F.struct(*first, *[col(c) for c in plain], *[comparable(col(c)).alias(c) for c in maps]) if shared else F.struct(*first, F.lit(1).alias("one"))
    usable = F.lit(True)
    for k in keys:
        usable = usable & col(k).isNotNull()
    picked = source.where(usable).groupBy(*[col(k) for k in keys]).agg(F.max(rank).alias("__new"))
    s = picked.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[(F.map_from_entries(F.col("__new")[c]) if c in maps else F.col("__new")[c]).alias(f"__s{i}") for i, c in enumerate(shared)], F.lit(True).alias("__hit"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & (col(k) == F.col(f"__k{i}"))
    j = target.join(s, on, "full_outer")
    added = F.col("__hit").isNotNull()
    for k in keys:
        added = added & col(k).isNull()
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.coalesce(col(c), F.col(f"__k{list(keys).index(c)}")).alias(c))
        elif c in shared:
            new = F.col(f"__s{shared.index(c)}")
            out.append((F.coalesce(new, col(c)) if c in update else F.when(added, new).otherwise(col(c))).alias(c))
        else:
            out.append(col(c))
    merged = j.select(*out)
    keyless = source.where(~usable).select(*[(col(c) if c in source.columns else F.lit(None).cast(target.schema[c].dataType)).alias(c) for c in target.columns])
    return merged.unionByName(keyless)


def insert_references(members: DataFrame, source: DataFrame, columns: dict[str, str], *, defaults: dict[str, Any] | None = None, optional: Sequence[str] = (), key: str = "id") -> DataFrame:
    """`members` with those that `source` names and that aren't there yet, given new surrogate keys.

    `columns` maps member columns (its natural key) to source columns. Nulls are filled from
    `defaults`; rows still null in a column that isn't `optional` name no member. Each new member is
    added once; null equals null in `optional` columns. Member columns beyond these are null.
    """
    require(source, *columns.values())
    defaults = defaults or {}
    picked = [(F.coalesce(col(s), F.lit(defaults[m])) if m in defaults else col(s)).alias(m) for m, s in columns.items()]
    named = source.select(*picked).dropna(subset=[m for m in columns if m not in optional] or None).distinct() if set(columns) - set(optional) else source.select(*picked).distinct()
    on = F.lit(True)
    for m in columns:
        on = on & F.col(f"n.`{m}`").eqNullSafe(F.col(f"m.`{m}`"))
    new = named.alias("n").join(members.alias("m"), on, "left_anti")
    numbered = surrogate.assign(new, list(columns), members, key)
    return members.unionByName(numbered.select(*[col(c).cast(members.schema[c].dataType).alias(c) for c in members.columns if c in numbered.columns]), allowMissingColumns=True)


@dataclass(frozen=True)
class Lookup:
    """One reference to be resolved: members and how their natural key is found in the source.

    `on` maps member columns to source columns (or to a Column). `label` tells roles of one table apart.
    """

    key: str
    members: DataFrame
    on: dict[str, str | Column]
    surrogate: str = "id"


def stage(source: DataFrame, lookups: Sequence[Lookup], keep: Sequence[str]) -> DataFrame:
    """`keep` columns of `source` and the surrogate key of each reference, null where no member matches.

    Every source row comes out once: members repeated under one key count as the one with the smallest
    surrogate. A null in the natural key matches nothing.
    """
    require(source, *keep)
    j = source
    for i, r in enumerate(lookups):
        names = [f"__m{i}_{k}" for k in range(len(r.on))]
        m = r.members.groupBy(*[col(c).alias(n) for c, n in zip(r.on, names)]).agg(F.min(col(r.surrogate)).alias(f"__id{i}"))
        on = F.lit(True)
        for n, s in zip(names, r.on.values()):
            on = on & (F.col(n) == (s if isinstance(s, Column) else col(s)))
        j = j.join(m, on, "left")
    return j.select(*[F.col(f"__id{i}").alias(r.key) for i, r in enumerate(lookups)], *[col(c) for c in keep])


def snapshot(ledger: DataFrame, *, keys: Sequence[str], attributes: Sequence[str], required: Sequence[str] = (), backwards: bool = False, start: str = "start_at", delta: str = "delta", uuid: str = "source_uuid", large: int = LARGE) -> DataFrame:
    """Complete states from partial change events: keys, attributes, `start`; one row per key and time.

    A record with `delta` 0 is complete and starts anew; others change what isn't null in them (maps
    are united). Backwards, a state is completed from what comes later instead. At one time the event
    with the greatest `uuid` counts. States with a null in `required` are left out, as are events
    without `start`. Keys of more than `large` events are spread over days.
    """
    require(ledger, *keys, *attributes, start, delta, uuid)
    rows = ledger.where(col(start).isNotNull()).select(*[col(c) for c in dict.fromkeys([*keys, *attributes, start, delta, uuid])])
    one = lambda bucket: lambda df: _snapshot(df, keys, attributes, required, backwards, start, delta, uuid, bucket)
    return by_size(rows, keys, one(None), one("day"), large)


def _snapshot(rows: DataFrame, keys: Sequence[str], attributes: Sequence[str], required: Sequence[str], backwards: bool, start: str, delta: str, uuid: str, unit: str | None) -> DataFrame:
    maps = [a for a in attributes if dict(rows.dtypes)[a].startswith("map<")]
    b, group, rn = free(rows.columns, "__day", "__group", "__rn")
    if unit:
        rows = rows.withColumn(b, F.date_trunc(unit, col(start)))
    bucket = b if unit else None
    s, u = (col(start).desc(), col(uuid).desc()) if backwards else (col(start).asc(), col(uuid).asc())
    mark = F.when(col(delta) == 0, F.struct(col(start).alias("s"), col(delta).alias("d"), col(uuid).alias("u")))
    grouped = running(rows, keys, bucket, [s, col(delta).asc(), u], {group: mark}, backwards=backwards)
    merged = running(grouped, [*keys, group], bucket, [s, u], {f"__v{i}": col(a) for i, a in enumerate(attributes)}, maps=[f"__v{i}" for i, a in enumerate(attributes) if a in maps], backwards=backwards)
    w = Window.partitionBy(*[col(k) for k in keys], *([col(b)] if unit else []), col(start)).orderBy(col(uuid).desc(), F.col(group).desc_nulls_first() if backwards else F.col(group).asc_nulls_first())
    single = merged.withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1)
    out = single.select(*[col(k) for k in keys], *[F.col(f"__v{i}").alias(a) for i, a in enumerate(attributes)], col(start))
    for r in required:
        out = out.where(col(r).isNotNull())
    return out


def deduplicate(states: DataFrame, *, keys: Sequence[str], attributes: Sequence[str], grain: str = "hourly", defaults: dict[str, Any] | None = None, start: str = "start_at", large: int = LARGE) -> DataFrame:
    """States thinned to `grain`: the last of each period, dated to its beginning, and of equal ones in a row the first.

    Nulls are equal to each other; maps are equal with equal entries. `defaults` fill nulls of the last
    state. Of states at the same time the greatest counts. Keys of more than `large` states are spread over months.
    """
    require(states, *keys, *attributes, start)
    one = lambda bucket: lambda df: _deduplicate(df, keys, attributes, grain, defaults or {}, start, bucket)
    return by_size(states, keys, one(None), one("month"), large)


def _deduplicate(states: DataFrame, keys: Sequence[str], attributes: Sequence[str], grain: str, defaults: dict[str, Any], start: str, unit: str | None) -> DataFrame:
    period = UNIT[grain]
    maps = {a for a in attributes if dict(states.dtypes)[a].startswith("map<")}
    at, b, prev, now, last = free(states.columns, "__at", "__bucket", "__prev", "__now", "__last")
    ordered = [comparable(col(a)).alias(a) if a in maps else col(a) for a in attributes]
    rows = states.where(col(start).isNotNull()).select(*[col(k) for k in keys], F.date_trunc(period, col(start)).cast(states.schema[start].dataType).alias(at), F.struct(col(start).alias("__s"), *ordered).alias(last))
    if unit:  # the last state of a period is a maximum, so it is combined on the map side
        ends = rows.groupBy(*[col(k) for k in keys], at).agg(F.max(last).alias(last))
    else:  # the rows of a key are in one place already, or go there once
        w = Window.partitionBy(*[col(k) for k in keys], at).orderBy(F.col(last).desc())
        ends = rows.withColumn(b, F.row_number().over(w)).where(F.col(b) == 1).drop(b)
    filled = [(F.coalesce(F.col(last)[a], F.lit(defaults[a])) if a in defaults else F.col(last)[a]).alias(a) for a in attributes] or [F.lit(1).alias("__one")]
    ends = ends.select(*[col(k) for k in keys], at, F.struct(*filled).alias(now), *([F.date_trunc(unit, F.col(at)).alias(b)] if unit else []))
    seen = running(ends, keys, b if unit else None, [F.col(at)], {prev: F.col(now)}, before=True)
    changed = seen.where(F.col(prev).isNull() | ~F.col(prev).eqNullSafe(F.col(now)))
    return changed.select(*[col(k) for k in keys], *[(F.map_from_entries(F.col(now)[a]) if a in maps else F.col(now)[a]).alias(a) for a in attributes], F.col(at).alias(start))


def relabel(history: DataFrame, *, keys: Sequence[str], start: str = "start_at", version: str = "version", end: str = "end_at", large: int = LARGE) -> DataFrame:
    """`history` with `version` numbered from 1 and `end` at the next version's start, null for the last.

    Rows with the same key and start share a version number (rank). Other columns are kept. Keys of more
    than `large` rows are spread over months.
    """
    require(history, *keys, start)
    one = lambda unit: lambda df: _relabel(df, keys, start, version, end, unit)
    return by_size(history.drop(version, end), keys, one(None), one("month"), large)


def _relabel(rest: DataFrame, keys: Sequence[str], start: str, version: str, end: str, unit: str | None) -> DataFrame:
    if unit is None:
        w = Window.partitionBy(*[col(k) for k in keys]).orderBy(col(start))
        return rest.select("*", F.rank().over(w).alias(version), F.lead(col(start)).over(w).alias(end))
    (b,) = free(rest.columns, "__bucket")
    return _bucketed(rest.withColumn(b, F.date_trunc(unit, col(start))), keys, start, [], b, version, end, rank=True, share=True).drop(b)


def consolidate(ledger: DataFrame, *, keys: Sequence[str], attributes: Sequence[str], required: Sequence[str] = (), defaults: dict[str, Any] | None = None, grain: str = "hourly", start: str = "start_at", delta: str = "delta", uuid: str = "source_uuid", target: DataFrame | None = None, large: int = LARGE) -> DataFrame:
    """A ledger of partial changes as versioned history: snapshot forwards and backwards, merge, thin out, relabel.

    The forward state counts, and what is unknown in it is taken from the backward one. With `target`
    (an earlier history) the result is merged into it before relabelling. Keys of at most `large` events
    are dealt out once, and all steps run on that; larger ones take the steps one by one, spread over time.
    """
    require(ledger, *keys, *attributes, start, delta, uuid)
    names = dict.fromkeys([*keys, *attributes, start, delta, uuid])
    rows = ledger.where(col(start).isNotNull()).select(*[col(c) for c in names])

    def usual(df: DataFrame) -> DataFrame:
        merged = _both_ways(df, keys, attributes, required, start, delta, uuid)
        return _deduplicate(merged, keys, attributes, grain, defaults or {}, start, None)

    def spread(df: DataFrame) -> DataFrame:
        ahead, back = (_snapshot(df, keys, attributes, required, backwards, start, delta, uuid, "day") for backwards in (False, True))
        return _deduplicate(upsert(back, ahead, [*keys, start], attributes), keys, attributes, grain, defaults or {}, start, "month")

    if target is None:
        return by_size(rows, keys, lambda df: _relabel(usual(df), keys, start, "version", "end_at", None), lambda df: _relabel(spread(df), keys, start, "version", "end_at", "month"), large)
    thin = by_size(rows, keys, usual, spread, large)
    return relabel(upsert(target, thin, [*keys, start], attributes), keys=keys, start=start, large=large)


def complete_states(ledger: DataFrame, *, keys: Sequence[str], attributes: Sequence[str], required: Sequence[str] = (), start: str = "start_at", delta: str = "delta", uuid: str = "source_uuid", large: int = LARGE) -> DataFrame:
    """The forward states of `ledger` filled up from the backward ones (see :func:`snapshot`): keys, attributes, `start`."""
    require(ledger, *keys, *attributes, start, delta, uuid)
    rows = ledger.where(col(start).isNotNull()).select(*[col(c) for c in dict.fromkeys([*keys, *attributes, start, delta, uuid])])

    def spread(df: DataFrame) -> DataFrame:
        ahead, back = (_snapshot(df, keys, attributes, required, backwards, start, delta, uuid, "day") for backwards in (False, True))
        return upsert(back, ahead, [*keys, start], attributes)

    return by_size(rows, keys, lambda df: _both_ways(df, keys, attributes, required, start, delta, uuid), spread, large)


def _both_ways(rows: DataFrame, keys: Sequence[str], attributes: Sequence[str], required: Sequence[str], start: str, delta: str, uuid: str) -> DataFrame:
    """The forward states, filled up from the backward ones, with all of a key's events in one place: windows over one exchange."""
    kinds = dict(rows.dtypes)
    ks = [col(k) for k in keys]
    mark = F.when(col(delta) == 0, F.struct(col(start).alias("s"), col(delta).alias("d"), col(uuid).alias("u")))
    df, picked = rows, []
    for way, backwards in (("f", False), ("r", True)):
        s, u = (col(start).desc(), col(uuid).desc()) if backwards else (col(start).asc(), col(uuid).asc())
        group, state = f"__{way}_group", f"__{way}_state"
        df = running(df, keys, None, [s, col(delta).asc(), u], {group: mark})
        values = {f"__{way}{i}": col(a) for i, a in enumerate(attributes)}
        df = running(df, [*keys, group], None, [s, u], values, maps=[n for n, a in zip(values, attributes) if kinds[a].startswith("map<")])
        ok = F.lit(True)
        for a in required:
            ok = ok & F.col(f"__{way}{list(attributes).index(a)}").isNotNull()
        w = Window.partitionBy(*ks, col(start)).orderBy(col(uuid).desc(), F.col(group).desc_nulls_first() if backwards else F.col(group).asc_nulls_first())
        df = df.withColumn(state, F.first(F.struct(ok.alias("ok"), *values)).over(w)).withColumn(f"__{way}_n", F.row_number().over(w)).drop(group, *values)
        picked.append(state)
    f, r = picked
    one = df.where((F.col("__f_n") == 1) & (F.col(f)["ok"] | F.col(r)["ok"]))
    best = [F.coalesce(F.when(F.col(f)["ok"], F.col(f)[f"__f{i}"]), F.when(F.col(r)["ok"], F.col(r)[f"__r{i}"])).alias(a) for i, a in enumerate(attributes)]
    return one.select(*ks, *best, col(start))


@dataclass(frozen=True)
class Join:
    """A reference to be written out: foreign key column, members, and member columns by output name.

    `nested` references hang off the members. `implicit` and degenerate references have no join: their
    columns are in the table already.
    """

    key: str
    members: DataFrame
    columns: dict[str, str]
    surrogate: str = "id"
    nested: Sequence[Join] = field(default_factory=tuple)


def denormalize(table: DataFrame, joins: Sequence[Join], keep: Sequence[str], *, order: Sequence[str] | None = None, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """`table` with foreign keys replaced by what they stand for, in the order of the output columns.

    Foreign keys without a member give nulls. `include` adds table columns, `exclude` drops output
    columns, `last_modified_at` is never given. `order` lists the columns to sort by, () for no sort.
    """
    j, out, n = table, [], 0

    def add(joins: Sequence[Join], prefix: str) -> None:
        nonlocal j, n
        for r in joins:
            pre = f"__j{n}_"
            n += 1
            renamed = r.members.select(*[col(c).alias(pre + c) for c in r.members.columns])
            j = j.join(renamed, col(prefix + r.key) == col(pre + r.surrogate), "left")
            out.extend((col(pre + c).alias(o), o) for o, c in r.columns.items())
            add(r.nested, pre)

    add(joins, "")
    own = [c for c in dict.fromkeys([*include, *keep]) if c != "last_modified_at"]
    pairs = [(c, o) for c, o in [*out, *[(col(c), c) for c in own]] if o not in exclude]
    result = j.select(*[c.alias(o) for c, o in pairs])
    by = [o for _, o in pairs] if order is None else list(order)
    return result.orderBy(*[col(o) for o in by]) if by else result
