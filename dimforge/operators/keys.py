"""Surrogate keys: numbers that depend only on what is there already and the new natural keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dimforge.functions.names import col, free

BUCKETS = 1024


def assign(new: DataFrame, natural: Sequence[str], existing: DataFrame | None = None, key: str = "id") -> DataFrame:
    """`new` with `key`: the numbers after the greatest existing one, without gaps.

    Rows are numbered by natural key within buckets of its hash, and buckets by what is in those
    before; no task sees all rows, and running again gives the same numbers.
    """
    b, n, base = free(new.columns, "__bucket", "__n", "__base")
    rows = new.withColumn(b, F.pmod(F.xxhash64(*[col(c) for c in natural]), F.lit(BUCKETS)))
    counts = rows.groupBy(b).agg(F.count(F.lit(1)).alias(n))
    counts = counts.select(b, F.coalesce(F.sum(n).over(Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(base))
    place = F.row_number().over(Window.partitionBy(b).orderBy(*[col(c) for c in natural]))
    top = existing.agg(F.coalesce(F.max(col(key)), F.lit(0)).cast("long")).scalar() if existing is not None else F.lit(0)
    numbered = rows.withColumn(n, place).join(F.broadcast(counts), b)  # at most BUCKETS rows
    return numbered.select((F.greatest(top, F.lit(0)) + F.col(base) + F.col(n)).cast("long").alias(key), *[col(c) for c in new.columns])
