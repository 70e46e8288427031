"""Facts: resolving references, rolling up to coarser grain, partitions by period."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimforge.functions.names import col, free, require
from dimforge.operators.asof import last_known, micros
from dimforge.schema.model import order_by_dependency

AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max, "average": F.avg}


@dataclass(frozen=True)
class Member:
    """A reference of a fact.

    `on` maps natural key columns of the members to source columns. `default` fills those that are null
    in the source; `through` names, per member column, other references (name, member column) whose
    matched member completes it first. `constant` gives member columns that must have a fixed value.
    `unknown` is the key where nothing matches; without it such facts are dropped. `temporal` members
    are versions (start_at, end_at, version): the one valid at the fact's time matches, or the first one for earlier facts.
    `degenerate` references pass their key through. `sequential` says that the versions of a key begin at different
    times and overlap, if at all, in the moment one ends and the next begins, as relabelled ones do: facts then meet them sorted by
    time (:func:`~dimforge.operators.asof.last_known`) and not version by version, which is quadratic for keys of many.
    """

    key: str
    members: DataFrame | None = None
    on: dict[str, str] = field(default_factory=dict)
    name: str = ""
    surrogate: str = "id"
    default: dict[str, Any] = field(default_factory=dict)
    through: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    constant: dict[str, Any] = field(default_factory=dict)
    unknown: Any = None
    temporal: bool = False
    degenerate: bool = False
    half_open: bool = False
    sequential: bool = False

    @property
    def label(self) -> str:
        return self.name or self.key


def valid_at(at: Column, start: Column, end: Column, version: Column, half_open: bool = False) -> Column:
    """Whether a version holds at `at`: within its period, ends included unless `half_open`; the first one also before it."""
    within = (at >= start) & (end.isNull() | ((at < end) if half_open else (at <= end)))
    return within | ((at < start) & (version == 1))


def stage_fact(source: DataFrame, references: Sequence[Member], *, time_key: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The facts of `source` with surrogate keys: one column per reference, then the `keep` columns.

    References are resolved after those they are completed through. `time_key` is in epoch seconds and
    needed for temporal members. Members repeated under one key repeat the fact, as in any join; a null
    in the completed natural key matches nothing.
    """
    by_name = {r.label: r for r in references}
    order = order_by_dependency({r.label: sorted({n for refs in r.through.values() for n, _ in refs}) for r in references})
    require(source, *keep)
    j = source
    pre: dict[str, str] = {}
    if any(r.temporal for r in references) and time_key is None:
        raise ValueError("temporal references need time_key")
    for i, name in enumerate(order):
        r = by_name[name]
        if r.degenerate:
            continue
        pre[name] = p = f"__r{i}_"
        need = dict.fromkeys([r.surrogate, *r.on, *r.constant, *(["start_at", "end_at", "version"] if r.temporal else []), *(c for o in references for refs in o.through.values() for n, c in refs if n == name)])
        m = r.members
        for c, v in r.constant.items():
            m = m.where(col(c) == F.lit(v))
        m = m.select(*[col(c).alias(p + c) for c in need])
        on = F.lit(True)
        for c in r.on:
            on = on & (col(p + c) == _given(r, c, pre))
        if r.temporal and r.sequential:
            j = _join_sequential(j, m, p, r, {c: _given(r, c, pre) for c in r.on}, time_key)
            continue
        if r.temporal:
            at = F.timestamp_seconds(col(time_key)).cast("timestamp_ntz")
            on = on & valid_at(at, col(p + "start_at"), col(p + "end_at"), col(p + "version"), r.half_open)
        j = j.join(m, on, "left" if r.unknown is not None else "inner")
    out = []
    for r in references:
        if r.degenerate:
            out.append(col(next(iter(r.on.values()), r.key)).alias(r.key))
        else:
            k = col(pre[r.label] + r.surrogate)
            out.append((F.coalesce(k, F.lit(r.unknown)) if r.unknown is not None else k).alias(r.key))
    return j.select(*out, *[col(c) for c in keep])


def _given(r: Member, column: str, pre: dict[str, str]) -> Column:
    """What the source says of a natural key column: its own value, else that of another reference's member, else the default."""
    parts = [col(r.on[column]), *[col(pre[n] + c) for n, c in r.through.get(column, [])]]
    if column in r.default:
        parts.append(F.lit(r.default[column]))
    return F.coalesce(*parts) if len(parts) > 1 else parts[0]


def _join_sequential(facts: DataFrame, members: DataFrame, prefix: str, r: Member, given: dict[str, Column], time_key: str) -> DataFrame:
    """`facts` with the columns of the versions valid at their time, as the join on key and period gives them."""
    e, t, v = free(facts.columns, "__e", "__t", "__v")
    start, end, version = (prefix + c for c in ("start_at", "end_at", "version"))
    keyed = F.lit(True)
    for c in r.on:
        keyed = keyed & col(prefix + c).isNotNull()
    # Struct fields go by place, and both sides of a comparison must have one type.
    kinds = {c: members.schema[prefix + c].dataType for c in r.on}
    own = members.where(keyed & col(start).isNotNull()).withColumn(e, F.struct(*[col(prefix + c).alias(f"k{i}") for i, c in enumerate(r.on)]))
    before = F.lag(F.struct(*[col(c) for c in members.columns])).over(Window.partitionBy(e).orderBy(col(start)))
    pair = F.struct(F.struct(F.struct(*[col(c) for c in members.columns]).alias("now"), F.col("__before").alias("was")).alias("value"))
    began = F.when(col(version) == 1, F.lit(-(2**62))).otherwise(micros(own, start))  # the first version holds before it begins, too
    changes = own.withColumn("__before", before).select(F.col(e).alias("e"), began.alias("at"), pair.alias("c0"))
    complete = F.lit(True)
    for c in given.values():
        complete = complete & c.isNotNull()
    key = F.struct(*[c.cast(kinds[n]).alias(f"k{i}") for i, (n, c) in enumerate(given.items())])
    events = facts.withColumn(e, F.when(complete, key)).withColumn(t, (col(time_key) * 1_000_000).cast("long"))
    met = last_known(events, changes, entity=e, time=t, slots_used=1)
    at, now, was = F.col("event")[t], F.col("c0")["value"]["now"], F.col("c0")["value"]["was"]
    us = lambda x, c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), x[c]) if isinstance(members.schema[c].dataType, T.TimestampNTZType) else F.unix_micros(x[c])
    ends = us(now, end)
    holds = now.isNotNull() & (ends.isNull() | ((at < ends) if r.half_open else (at <= ends)) | ((at < us(now, start)) & (now[version] == 1)))
    both = F.lit(False) if r.half_open else was.isNotNull() & (at == us(was, end)) & (at >= us(now, start))
    some = F.array_compact(F.array(F.when(both, was), F.when(holds, now)))
    how = F.explode_outer if r.unknown is not None else F.explode
    return met.select("event", how(some).alias(v)).select(*[F.col("event")[c].alias(c) for c in facts.columns], *[F.col(v)[c].alias(c) for c in members.columns])


def date_of(key: Column) -> Column:
    """The date that a yyyymmdd number names; null if it names none."""
    return F.try_to_date(key.cast("string"), "yyyyMMdd")


def month_key(key: Column) -> Column:
    """The yyyymmdd number of the first day of the month of a yyyymmdd number."""
    return (F.floor(key / 100).cast("int") * 100 + 1).cast("int")


def rollup(fact: DataFrame, *, grain: str, date_key: str, keys: Sequence[str] = (), measures: dict[str, str], time_key: str = "time_key", members: DataFrame | None = None, member_key: str = "id", member_date: str = "date_id", between: tuple[int, int] | None = None) -> DataFrame:
    """`fact` at a coarser grain: date key, `keys`, measures and the period's `time_key` (epoch seconds).

    hourly keeps the date and cuts `time_key` to the hour; daily and monthly take the time from the date.
    `measures` maps columns to sum, min, max or average. The date key is the yyyymmdd number itself, or,
    with `members` (the date dimension), a foreign key that is looked up there; facts without a date
    there are dropped. `between` (epoch seconds, the end excluded) reads only facts of that time. Partial sums are made before the shuffle. An average of averages is what it says.
    """
    require(fact, date_key, *keys, *measures)
    unknown = [a for a in measures.values() if a not in AGGREGATE]
    if unknown:
        raise ValueError(f"unknown aggregates {unknown}")
    rows = fact
    if between is not None:
        rows = in_period(rows, *between, time_key)
    if members is not None:
        d = members.select(col(member_key).alias("__dk"), col(member_date).alias("__date"))
        rows = rows.join(d, col(date_key) == F.col("__dk")).drop("__dk")
        date = F.col("__date")
    else:
        date = col(date_key)
    if grain == "hourly":
        require(fact, time_key)
        bucket, when_ = date, col(time_key) - F.pmod(col(time_key), F.lit(3600))
    elif grain == "daily":
        bucket, when_ = date, F.unix_seconds(date_of(date).cast("timestamp"))
    elif grain == "monthly":
        bucket, when_ = month_key(date), F.unix_seconds(date_of(month_key(date)).cast("timestamp"))
    else:
        raise ValueError(f"unknown grain {grain}")
    grouped = rows.groupBy(bucket.cast("int").alias(date_key), *[col(k) for k in keys], when_.cast("long").alias("__when"))
    return grouped.agg(*[AGGREGATE[a](col(m)).alias(m) for m, a in measures.items()]).withColumnRenamed("__when", time_key)


def with_period(fact: DataFrame, time_key: str = "time_key", name: str = "period") -> DataFrame:
    """Add the partition a fact belongs to: y2024m02."""
    t = F.timestamp_seconds(col(time_key))
    return fact.withColumn(name, F.concat(F.lit("y"), F.date_format(t, "yyyy"), F.lit("m"), F.date_format(t, "MM")))


def in_period(fact: DataFrame, start: int, stop: int, time_key: str = "time_key") -> DataFrame:
    """Facts with `start` <= time < `stop`, in epoch seconds; pushed down to the scan."""
    return fact.where((col(time_key) >= start) & (col(time_key) < stop))
