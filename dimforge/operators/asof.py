"""Attributes as they were known at event time.

Each attribute has a change history of its own: an entry (entity, moment, value) where what was known of
that attribute changed, and none where another one did; a version that was recorded late counts
from the moment it was recorded, and only if nothing newer was known by then. Histories of attributes
kept in different tables, changing at different times, are put together the same way. Events then meet
the histories, sorted by entity and time: the last entry of each attribute before an event is found
separately, and the values are given back side by side.

Entities with very many events are told first, by a count. Their events are spread over buckets of time
and salts; every bucket starts with what the entity's earlier buckets carry over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimforge.functions.merge import comparable
from dimforge.functions.names import col, require
from dimforge.operators.scan import LARGE, large_keys

DAY_US = 86_400_000_000
SALTS = 16


def micros(df: DataFrame, name: str):
    """Column `name` as bigint microseconds since 1970 (numbers are taken to be that already)."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col(name))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col(name))
    return col(name).cast("long")


def _is_map(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.MapType)


def slots(n: int) -> list[str]:
    return [f"c{i}" for i in range(n)]


def change_histories(history: DataFrame, *, entity: str, valid_from: str, known_from: str, tie: str, attributes: Sequence[str], bucket_us: int = DAY_US, large: int = LARGE) -> DataFrame:
    """The change histories of `attributes`: `e`, `at` (microseconds) and a column `c0`, `c1`... for each attribute.

    A row says that from `at` on the attributes whose column isn't null have the value in it (a struct of one
    field, so that null is a value); the others stay as they were. At any moment the row with the greatest valid-from,
    then known-from, then `tie` counts, of those with both times at or before it. Rows without an entity or either
    time can't be known at any moment and are left out.
    """
    require(history, entity, valid_from, known_from, tie, *attributes)
    since, seen = micros(history, valid_from), micros(history, known_from)
    values = F.struct(*[(comparable(col(a)) if _is_map(history, a) else col(a)).alias(c) for a, c in zip(attributes, slots(len(attributes)))])
    usable = history.where(col(entity).isNotNull() & col(valid_from).isNotNull() & col(known_from).isNotNull())
    rank = F.struct(since.alias("since"), seen.alias("seen"), col(tie).alias("tie"), values.alias("v"))
    rows = usable.select(col(entity).alias("e"), F.greatest(since, seen).alias("at"), rank.alias("rank"))
    hot = large_keys(rows, F.col("e"), large)

    def changes(ranked: DataFrame, keys: list[str]) -> DataFrame:
        """Of rows with `best`, what was known just after each, and `carried`, before the first: where an attribute changed."""
        kept = ranked.where(F.col("rank") == F.col("best"))
        prev = F.coalesce(F.lag("rank").over(Window.partitionBy(*keys).orderBy("at")), F.col("carried"))
        seen_before = kept.withColumn("prev", prev)
        first = F.col("prev").isNull()
        out = [F.when(first | ~F.col("rank.v")[c].eqNullSafe(F.col("prev.v")[c]), F.struct(F.col("rank.v")[c].alias("value"))).alias(c) for c in slots(len(attributes))]
        return seen_before.select("e", "at", *out).where(" or ".join(f"{c} is not null" for c in slots(len(attributes))))

    none = F.lit(None).cast(rows.schema["rank"].dataType)
    w = Window.partitionBy("e").orderBy("at")  # rows at one moment see each other
    usual = (rows if hot is None else rows.join(hot, F.col("e") == F.col("hot"), "left_anti")).select("*", F.max("rank").over(w).alias("best"), none.alias("carried"))
    if hot is None:
        return changes(usual, ["e"])
    spread = rows.join(hot, F.col("e") == F.col("hot"), "left_semi").withColumn("b", F.floor(F.col("at") / bucket_us))
    ends = spread.groupBy(F.col("e").alias("e2"), F.col("b").alias("b2")).agg(F.max("rank").alias("end"))
    earlier = Window.partitionBy("e2").orderBy("b2").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("e2", "b2", F.max("end").over(earlier).alias("carried"))
    w = Window.partitionBy("e", "b").orderBy("at")
    bucketed = spread.join(carried, (F.col("e") == F.col("e2")) & (F.col("b") == F.col("b2"))).withColumn("best", F.greatest(F.max("rank").over(w), "carried"))
    return changes(usual, ["e"]).unionByName(changes(bucketed, ["e", "b"]))


def last_known(events: DataFrame, changes: DataFrame, *, entity: str, time: str, slots_used: int, bucket_us: int = DAY_US, large: int = LARGE, salts: int = SALTS, crowd: DataFrame | None = None) -> DataFrame:
    """`event` (a struct of the columns of `events`) and, of the `slots_used` columns c0, c1... of `changes` (see :func:`change_histories`), the last entry at or before it.

    `crowd` is counted in place of `events` to find entities of very many rows: any table that has each of the
    events' entities at least as often, where making `events` costs more than reading it.
    """
    names = slots(slots_used)
    body = F.struct(*[col(c) for c in events.columns])
    timed = col(entity).isNotNull() & col(time).isNotNull()
    at = micros(events, time)
    of = events if crowd is None else crowd
    hot = large_keys(of.where(col(entity).isNotNull()), col(entity), large)

    def matched(rows: DataFrame, keys: list[str]) -> DataFrame:
        so_far = Window.partitionBy(*keys).orderBy("at", F.col("event").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("event", *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in names]).where(F.col("event").isNotNull())

    # Events that have no place match nothing; they are dealt over many groups of their own.
    lone = F.when(timed, F.lit(0)).otherwise(F.pmod(F.xxhash64(*[col(c) for c, k in events.dtypes if "map<" not in k]), F.lit(1 << 16)).cast("int") + 1)
    usual = (events if hot is None else events.join(hot, col(entity) == F.col("hot"), "left_anti")).select(F.when(timed, col(entity)).alias("e"), lone.alias("s"), at.alias("at"), body.alias("event"))
    found = matched(changes.select("e", F.lit(0).alias("s"), "at", *names).unionByName(usual, allowMissingColumns=True), ["e", "s"])
    if hot is None:
        return found
    theirs = changes.join(hot, F.col("e") == F.col("hot"), "left_semi").withColumn("b", F.floor(F.col("at") / bucket_us))
    ends = theirs.groupBy("e", "b").agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("at").alias("t"), F.col(c).alias("x")))).alias(c) for c in names])
    # An entity's buckets are the days of its changes; events belong to the last one begun, and are told apart by salt. What is
    # carried over comes before any change at a bucket's first moment.
    upto = Window.partitionBy("e").orderBy("b")
    spans = ends.select("e", "b", *[F.max(c).over(upto.rowsBetween(Window.unboundedPreceding, -1)).alias(c) for c in names])
    each = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s")
    starts = spans.select("e", "b", each, (F.col("b") * bucket_us - 1).alias("at"), *[F.col(c)["x"].alias(c) for c in names])
    inside = theirs.select("e", "b", each, "at", *names)
    mine = events.join(hot, col(entity) == F.col("hot"), "left_semi").select(col(entity).alias("he"), at.alias("at"), body.alias("event"))
    days = spans.groupBy(F.col("e").alias("de")).agg(F.array_sort(F.collect_list("b")).alias("days"))  # at most one per day of a hot entity
    begun = F.filter("days", lambda d: d <= F.floor(F.col("at") / bucket_us))
    placed = mine.join(days, F.col("he") == F.col("de"), "left").select(F.col("he").alias("e"), F.try_element_at(begun, F.lit(-1)).alias("b"), F.pmod(F.xxhash64("at", *[F.col("event")[c] for c, k in events.dtypes if "map<" not in k]), F.lit(salts)).cast("int").alias("s"), "at", "event")
    crowded = matched(starts.unionByName(inside).unionByName(placed, allowMissingColumns=True), ["e", "b", "s"])
    return found.unionByName(crowded)


def known_at(events: DataFrame, history: DataFrame, *, entity: str, time: str, history_entity: str, valid_from: str, known_from: str, tie: str, attributes: Sequence[str], prefix: str = "known_", bucket_us: int = DAY_US, large: int = LARGE, salts: int = SALTS, crowd: DataFrame | None = None) -> DataFrame:
    """`events` with, of each of `attributes`, the value valid and already known at column `time`.

    Among the history rows of the entity with both times at or before the event's, the greatest
    valid-from, then known-from, then `tie` counts. All event rows and columns are kept, repeated ones too;
    columns `prefix` + attribute are added, null where nothing was known (also for events without an
    entity or time, and for an empty history). `crowd`: see :func:`last_known`.
    """
    require(events, entity, time)
    outs = [prefix + a for a in attributes]
    if set(outs) & set(events.columns):
        raise ValueError(f"already columns: {sorted(set(outs) & set(events.columns))}")
    changes = change_histories(history, entity=history_entity, valid_from=valid_from, known_from=known_from, tie=tie, attributes=attributes, bucket_us=bucket_us, large=large)
    found = last_known(events, changes, entity=entity, time=time, slots_used=len(attributes), bucket_us=bucket_us, large=large, salts=salts, crowd=crowd)
    value = lambda c, a: F.map_from_entries(F.col(c)["value"]) if _is_map(history, a) else F.col(c)["value"]
    return found.select(*[F.col("event")[c].alias(c) for c in events.columns], *[value(c, a).alias(o) for c, a, o in zip(slots(len(attributes)), attributes, outs)])
