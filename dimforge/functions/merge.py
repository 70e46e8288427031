"""Merging aggregates: last value that isn't null, and right-biased union of maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from dimforge.functions.names import col, free


def coalesce_merge(c: Column, w: WindowSpec | None = None) -> Column:
    """The last value that isn't null, over a window in its order."""
    last = F.last(c, ignorenulls=True)
    return last.over(w) if w is not None else last


def coalesce_last(c: Column, order: Column) -> Column:
    """Aggregate: the last value that isn't null, by rising `order`; combined on the map side."""
    return F.max_by(c, F.when(c.isNotNull(), order))


def map_union(a: Column, b: Column) -> Column:
    """Entries of both; where both have a key, the right one's. Null maps add nothing."""
    left = F.coalesce(a, F.create_map().cast("map<string,string>"))
    right = F.coalesce(b, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def map_merge(m: Column, order: Column) -> Column:
    """Aggregate: union of the maps of a group by rising `order`, later entries winning.

    Decided entry by entry after exploding would shuffle more; here only the group's maps meet. Use
    :func:`merge_entries` where groups can be large.
    """
    listed = F.array_sort(F.collect_list(F.when(m.isNotNull(), F.struct(order.alias("o"), F.map_entries(m).alias("m")))))
    start = F.create_map().cast("map<string,string>")
    return F.aggregate(listed, start, lambda acc, x: map_union(acc, F.map_from_entries(x["m"])))


def merge_entries(df: DataFrame, keys: Sequence[str], m: Column, order: Column, name: str) -> DataFrame:
    """`keys` and, as `name`, what :func:`map_merge` gives for each group, for groups of any size.

    Entries are decided one by one, combined on the map side; only a group's last ones meet in one row.
    """
    k, v, o = free([*keys, name], "__k", "__v", "__o")
    entries = df.select(*[col(x) for x in keys], F.struct(order.alias("o")).alias(o), F.explode_outer(m).alias(k, v))
    last = entries.groupBy(*[col(x) for x in keys], F.col(k)).agg(F.max_by(v, o).alias(v))
    listed = F.collect_list(F.when(F.col(k).isNotNull(), F.struct(k, v)))
    return last.groupBy(*[col(x) for x in keys]).agg(F.map_from_entries(listed).alias(name))


def comparable(m: Column) -> Column:
    """A map as something that can be compared and grouped: its entries in key order."""
    return F.array_sort(F.map_entries(m))


def json_to_map(c: Column) -> Column:
    return F.from_json(c, "map<string,string>")
