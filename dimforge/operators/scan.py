"""Running values per key that don't need a key's rows in one task.

A key's rows are cut into buckets of time. Within a bucket a window runs over the rows; what a bucket
ends with is carried to the key's later buckets through a table with one row per key and bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dimforge.functions.merge import map_union
from dimforge.functions.names import all_columns, col, dealt, free


#: Rows above which a key is cut into buckets.
LARGE = 1_000_000


def large_keys(df: DataFrame, key: Column, large: int = LARGE) -> DataFrame | None:
    """Values of `key` with more than `large` rows, as `hot`, to be broadcast; None if there are none, which is found out at once.

    A count combined on the map side, of the key alone; there is at most one such value per `large` rows. Asking first
    keeps what is done for them out of plans that have none.
    """
    hot = df.groupBy(key.alias("hot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select("hot")
    return F.broadcast(hot) if hot.head(1) else None


def by_size(df: DataFrame, keys: Sequence[str], usual: Callable[[DataFrame], DataFrame], spread: Callable[[DataFrame], DataFrame], large: int = LARGE) -> DataFrame:
    """`usual` of the rows whose `keys` (nulls equal) have at most `large` rows, and `spread` of the others."""
    (e,) = free(df.columns, "__entity")
    key = F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    hot = large_keys(df, key, large)
    if hot is None:
        return usual(df)
    rows = df.withColumn(e, key)
    some = lambda how: rows.join(hot, F.col(e) == F.col("hot"), how).drop(e)
    return usual(some("left_anti")).unionByName(spread(some("left_semi")))


def null_safe(pairs: Sequence[tuple[Column, Column]]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out = out & a.eqNullSafe(b)
    return out


def running(df: DataFrame, keys: Sequence[str], bucket: str | None, order: Sequence[Column], values: dict[str, Column], *, maps: Sequence[str] = (), backwards: bool = False, before: bool = False) -> DataFrame:
    """Add to each row, per name in `values`, the last non-null value so far in `order` among rows of its `keys`.

    Rows equal in `order` see each other. `maps` names values that are string maps: they are united, later
    entries winning, instead of replaced. With no `bucket` a key's rows are taken in one task. Else `bucket` must rise (fall, if `backwards`) along `order`. With
    `before` a row doesn't see itself: the value of the row just before, which then must not be null.
    """
    keys = list(keys)
    if bucket is None:
        w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)
        w = w.rowsBetween(Window.unboundedPreceding, -1) if before else w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        start = F.create_map().cast("map<string,string>")
        return df.select("*", *[(F.aggregate(F.collect_list(v).over(w), start, map_union) if k in maps else F.last(v, ignorenulls=True).over(w)).alias(k) for k, v in values.items()])
    df = dealt(df, *keys, bucket)
    inner = Window.partitionBy(*[col(k) for k in keys], col(bucket)).orderBy(*order)
    frame = inner.rowsBetween(Window.unboundedPreceding, -1) if before else inner.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = free(df.columns, *[f"__in{i}" for i in range(len(values))])
    ends = free([*df.columns, *names], *[f"__end{i}" for i in range(len(values))])
    (n,) = free([*df.columns, *names, *ends], "__n")
    start = F.create_map().cast("map<string,string>")

    def over(name: str, v: Column, w) -> Column:
        if name in maps:
            return F.aggregate(F.collect_list(v).over(w), start, map_union)
        return F.last(v, ignorenulls=True).over(w)

    rows = df.select("*", F.row_number().over(inner).alias(n), *[over(k, v, frame).alias(i) for (k, v), i in zip(values.items(), names)], *[over(k, v, whole).alias(e) for (k, v), e in zip(values.items(), ends)])
    ks = [f"__k{i}" for i in range(len(keys))]
    outs = [f"__c{i}" for i in range(len(values))]
    last = rows.where((F.col(n) == 1) & all_columns(df)).select(*[col(k).alias(a) for k, a in zip(keys, ks)], col(bucket).alias("__b"), *ends)
    outer = Window.partitionBy(*ks).orderBy(F.col("__b").desc() if backwards else F.col("__b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*ks, "__b", *[over(k, F.col(e), outer).alias(c) for k, e, c in zip(values, ends, outs)])
    j = rows.join(carried, null_safe([*[(col(k), F.col(a)) for k, a in zip(keys, ks)], (col(bucket), F.col("__b"))]), "left")
    merged = [map_union(F.col(c), F.col(i)) if k in maps else F.coalesce(F.col(i), F.col(c)) for k, i, c in zip(values, names, outs)]
    return j.select(*[col(c) for c in df.columns], *[m.alias(k) for k, m in zip(values, merged)])
