"""Streams into warehouse tables: each micro-batch is staged like a batch load and committed by a new version of the table.

A stream has no state of its own here. A batch that is repeated after a failure replaces what it wrote before, so every
row is there once; late rows come into the periods they belong to beside those that are there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dimforge.functions.names import col
from dimforge.operators.dimensions import upsert
from dimforge.operators.facts import with_period
from dimforge.sources.writers import Warehouse


def load_facts(stream: DataFrame, warehouse: Warehouse, table: str, stage: Callable[[DataFrame], DataFrame], checkpoint: str, *, time_key: str = "time_key") -> StreamingQuery:
    """Append staged facts to `table`, which :func:`facts` reads: kept by batch and period, replaced batch by batch."""

    def batch(df: DataFrame, n: int) -> None:
        staged = with_period(stage(df), time_key)
        warehouse.replace_periods(table, staged.withColumn("part", F.concat(F.lit(f"{n:010d} "), "period")), "part")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def facts(warehouse: Warehouse, table: str) -> DataFrame:
    """What :func:`load_facts` has put into `table`."""
    return warehouse.read(table).drop("part")


def upsert_dimension(stream: DataFrame, warehouse: Warehouse, table: str, keys: Sequence[str], checkpoint: str, update: Sequence[str] | None = None, buckets: int = 256) -> StreamingQuery:
    """Merge each micro-batch into `table`, which :func:`dimension` reads; repeating one changes nothing.

    The table is kept in `buckets` by a hash of the keys; a batch rewrites those it has rows for, and reads no others.
    """

    def batch(df: DataFrame, n: int) -> None:
        rows = df.withColumn("part", F.pmod(F.xxhash64(*[col(k) for k in keys]), F.lit(buckets)).cast("string"))
        touched = [r[0] for r in rows.select("part").distinct().collect()]  # at most `buckets`
        have = warehouse.read(table).where(F.col("part").isin(touched)) if warehouse.exists(table) else rows.limit(0)
        merged = upsert(have.drop("part"), df, keys, update)
        warehouse.replace_periods(table, merged.withColumn("part", F.pmod(F.xxhash64(*[col(k) for k in keys]), F.lit(buckets)).cast("string")), "part")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dimension(warehouse: Warehouse, table: str) -> DataFrame:
    """What :func:`upsert_dimension` has put into `table`."""
    return warehouse.read(table).drop("part")
