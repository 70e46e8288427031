"""Replay of a feed of inserts, updates and deletes into the current state of a table.

Deliveries are first assembled into changes (late, repeated and corrected deliveries of one change
leave one row), changes into transactions, which have or are given commit numbers. State is exposed
only up to the committed watermark: the last transaction before the first gap or incomplete one. Changes of different keys don't conflict
and are replayed in parallel; the replay of one key is an associative merge (last complete record,
last removal, last setter of each attribute), so it is combined on the map side and a key that holds
a third of the feed costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dimforge.functions.names import col, free, require
from dimforge.session import materialise

COMPLETE, PARTIAL, REMOVAL = 0, 1, -1


def canonical_uuid(c: Column) -> Column:
    """Lower case 8-4-4-4-12; braces, hyphens, blanks and a urn prefix aside. Other text only loses case and blanks."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "^urn:uuid:", ""), r"[{}()\s-]", "")
    dashed = F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), dashed).otherwise(F.lower(F.trim(c)))


def assemble(deliveries: DataFrame, change: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """One row per change: of deliveries equal in `change` (nulls equal), the one greatest by `newest`.

    All columns are kept. Null sorts lowest in `newest`. Two deliveries equal in everything named
    leave the greatest by their remaining columns, so the result never depends on row order.
    """
    require(deliveries, *change, *newest)
    rest = [c for c in deliveries.columns if c not in change and c not in newest]
    (best,) = free(deliveries.columns, "__best")
    carried = F.struct(*[col(c) for c in [*newest, *rest]])
    kinds = dict(deliveries.dtypes)
    # Maps have no order; they are carried along, but don't decide.
    ordered = [c for c in [*newest, *rest] if "map<" not in kinds[c] and "variant" not in kinds[c]]
    one = F.max(carried) if len(ordered) == len(newest) + len(rest) else F.max_by(carried, F.struct(*[col(c) for c in ordered]))
    got = deliveries.groupBy(*[col(c) for c in change]).agg(one.alias(best))
    return got.select(*[col(c) if c in change else F.col(best)[c].alias(c) for c in deliveries.columns])


def sequence(changes: DataFrame, order: Sequence[str], name: str = "commit", bucket: str = "hour", bucketed: str | None = None) -> DataFrame:
    """`changes` with bigint `name`: the commit number, from 1 without gaps, of the transaction each belongs to.

    Changes equal in all of `order` are one transaction; transactions are numbered in that order, nulls
    lowest. The first of `order` is a time; changes without it have no place and no number. Numbers are
    counted within buckets of that time (a date_trunc unit; `bucketed` names a column that has them already) and
    moved on by what earlier buckets hold, so no task sees more than a bucket. The changes are written once, to
    the shared folder, as the log that both the buckets' sums and the result read. Other columns are kept.
    """
    require(changes, *order, *([bucketed] if bucketed else []))
    b, local, base = free([*changes.columns, name], "__bucket", "__local", "__base")
    w = Window.partitionBy(col(bucketed) if bucketed else F.col(b)).orderBy(*[col(c) for c in order])
    placed = changes.withColumn(b, col(bucketed) if bucketed else F.date_trunc(bucket, col(order[0])))
    counted = materialise(placed.withColumn(local, F.when(col(order[0]).isNotNull(), F.dense_rank().over(w))), "commits")
    tops = counted.where(F.col(b).isNotNull()).groupBy(F.col(b).alias("__b")).agg(F.max(local).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))  # one row per bucket
    tops = tops.select("__b", F.coalesce(before, F.lit(0)).alias(base))
    numbered = counted.join(tops, F.col(b) == F.col("__b"), "left")
    return numbered.select(*[col(c) for c in changes.columns], (F.col(local) + F.col(base)).cast("long").alias(name))


def watermark(changes: DataFrame, sequence: str, size: str | None = None, first: int = 1) -> DataFrame:
    """One row, `watermark` bigint: the last commit number up to which every transaction is complete.

    A transaction is complete when it has as many changes as its `size` says (any, if no size is
    given). `first` - 1 when transaction `first` itself is missing; numbers below `first` don't count.
    """
    done = changes.where(col(sequence) >= first).groupBy(col(sequence).cast("long").alias("n")).agg(F.count(F.lit(1)).alias("got"), F.max(col(size) if size else F.lit(0)).alias("want"))
    done = done.where(F.lit(True) if size is None else (F.col("got") >= F.col("want"))).select("n")
    ends = done.join(done.select((F.col("n") - 1).alias("n")), "n", "left_anti")
    begun = done.agg(F.min("n").alias("lowest"))
    lowest = ends.agg(F.min("n").alias("end"))
    return lowest.select(F.when(begun.scalar() == first, F.col("end")).otherwise(F.lit(first - 1)).cast("long").alias("watermark"))


def committed(changes: DataFrame, sequence: str, size: str | None = None, first: int = 1) -> DataFrame:
    """The changes at or below the watermark; those above it, or without a number, are held."""
    return changes.where(col(sequence).cast("long") <= watermark(changes, sequence, size, first).scalar())


def replay(changes: DataFrame, *, key: Sequence[str], order: Sequence[str], op: str, attributes: Sequence[str], origin: Sequence[str] = ()) -> DataFrame:
    """Current state: one row per existing key with, of each attribute, its value and who set it.

    `changes` holds one row per change (see :func:`assemble`), effective in `order`. `op` is 0 for a
    complete record (a null leaves the attribute empty), 1 for a partial change (null: unchanged; no
    effect on a key that doesn't exist then), -1 for a removal. Output: the key columns and per
    attribute a struct `value` plus the `origin` columns of the change that set it last, or null if
    it is empty. Rows with a null in the key, the first order column or `op`, or another `op`, have
    no effect: they can't be placed. An empty feed gives an empty state.
    """
    require(changes, *key, *order, op, *attributes, *origin)
    at = F.struct(*[col(c) for c in order])
    placed = changes.where(F.expr(" and ".join(["true"] + [f"`{c}` is not null" for c in [*key, order[0], op]])))
    aggs = [F.max(F.when(col(op) == COMPLETE, at)).alias("complete"), F.max(F.when(col(op) == REMOVAL, at)).alias("removal")]
    for i, a in enumerate(attributes):
        setter = F.struct(at.alias("at"), F.struct(col(a).alias("value"), *[col(c).alias(c) for c in origin]).alias("got"))
        aggs.append(F.max(F.when(col(op).isin(COMPLETE, PARTIAL) & col(a).isNotNull(), setter)).alias(f"set{i}"))
    keys = [f"key{i}" for i in range(len(key))]
    folded = placed.groupBy(*[col(k).alias(n) for k, n in zip(key, keys)]).agg(*aggs)
    alive = folded.where(F.col("complete").isNotNull() & (F.col("removal").isNull() | (F.col("removal") < F.col("complete"))))
    kept = [F.when(F.col(f"set{i}")["at"] >= F.col("complete"), F.col(f"set{i}")["got"]).alias(a) for i, a in enumerate(attributes)]
    return alive.select(*[F.col(n).alias(k) for k, n in zip(key, keys)], *kept)


def setters(state: DataFrame, key: Sequence[str], attributes: Sequence[str], origin: Sequence[str]) -> DataFrame:
    """:func:`replay`'s result as one row per key and attribute that isn't empty: key, `attribute`, origin columns."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), *[col(a)[c].alias(c) for c in origin], col(a).isNotNull().alias("filled")) for a in attributes])
    rows = state.select(*[col(k) for k in key], F.explode(pairs).alias("p"))
    return rows.where("p.filled").select(*[col(k) for k in key], F.col("p.attribute").alias("attribute"), *[F.col("p")[c].alias(c) for c in origin])
