"""The planner's questions over DataFrames of elements and listings, for plans too large for a driver.

An element is a time (the beginning of its period); a listing has `path`, `mtime`, and the time of each
path by its pattern. Steps are hour, day, month or year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dimforge.plans.pattern import Pattern

_INTERVAL = {"hour": "interval 1 hour", "day": "interval 1 day", "month": "interval 1 month", "year": "interval 1 year"}


def cut(c: Column, step: str) -> Column:
    return F.date_trunc(step, c).cast("timestamp_ntz")


def generate(spark: SparkSession, start: str, stop: str, step: str) -> DataFrame:
    """`at`: every period from `start` to `stop`, both included."""
    lo, hi = (cut(F.lit(x).cast("timestamp_ntz"), step) for x in (start, stop))
    return spark.range(1).select(F.explode(F.sequence(lo, F.greatest(lo, hi), F.expr(_INTERVAL[step]))).alias("at"))


def bind(listing: DataFrame, pattern: Pattern, path: str = "path", below: bool = False) -> DataFrame:
    """`listing` with `at`, the time each path is for; paths that are no instances (with `below`, nor in the folder of one) are left out."""
    return listing.withColumn("at", cut(pattern.time_column(F.col(path), below), pattern.step)).where("at is not null")


def missing(expected: DataFrame, have: DataFrame) -> DataFrame:
    return expected.select("at").distinct().join(have.select("at"), "at", "left_anti")


def existing(expected: DataFrame, have: DataFrame) -> DataFrame:
    return have.join(expected.select("at").distinct(), "at", "left_semi")


def adjacent(elements: DataFrame, step: str, window: int) -> DataFrame:
    """Each element with `window` steps before and after it, once."""
    near = F.sequence(F.lit(-window), F.lit(window))
    moved = F.expr(f"`at` + n * {_INTERVAL[step]}") if step != "year" else F.expr("`at` + n * interval 12 months")
    return elements.select("at", F.explode(near).alias("n")).select(moved.cast("timestamp_ntz").alias("at")).distinct()


def with_grain(elements: DataFrame, grain: str) -> DataFrame:
    return elements.select(cut(F.col("at"), grain).alias("at")).distinct()


def sources_of(targets: DataFrame, target_step: str, source_step: str) -> DataFrame:
    """`target`, `at`: the source periods in each target period, or the one it falls into."""
    end = F.expr(f"`at` + {_INTERVAL[target_step]} - {_INTERVAL[source_step]}").cast("timestamp_ntz")
    first = cut(F.col("at"), source_step)
    return targets.select(F.col("at").alias("target"), F.explode(F.sequence(first, F.greatest(first, end), F.expr(_INTERVAL[source_step]))).alias("at"))


def incomplete(targets: DataFrame, target_step: str, source_step: str, sources: DataFrame) -> DataFrame:
    """Targets whose sources are there for fewer dates than they should be."""
    want = sources_of(targets, target_step, source_step)
    seen = want.join(sources.select("at").distinct().withColumn("here", F.lit(True)), "at", "left")
    day = F.to_date("at")
    counts = seen.groupBy("target").agg(F.countDistinct(day).alias("expected"), F.countDistinct(F.when(F.col("here"), day)).alias("got"))
    return counts.where("expected <> got").select(F.col("target").alias("at"))


def stale(targets: DataFrame, target_step: str, source_step: str, sources: DataFrame) -> DataFrame:
    """Targets (`at`, `mtime`) with a source that was changed later, by the minute."""
    minute = lambda c: F.date_trunc("minute", c)
    latest = sources.groupBy("at").agg(F.max(minute("mtime")).alias("source_mtime"))
    want = sources_of(targets.select("at").distinct(), target_step, source_step).join(latest, "at")
    newest = want.groupBy("target").agg(F.max("source_mtime").alias("newest"))
    mine = targets.groupBy("at").agg(F.max(minute("mtime")).alias("mine"))
    return mine.join(newest, F.col("at") == F.col("target")).where("newest > mine").select("at")


def actionable(expected: DataFrame, targets: DataFrame, target_step: str, source_step: str, sources: DataFrame) -> DataFrame:
    """Expected targets that are missing, incomplete or stale, each once."""
    have = existing(expected, targets)
    return missing(expected, targets).union(incomplete(expected, target_step, source_step, sources)).union(stale(have, target_step, source_step, sources)).distinct()


def updateable(expected: DataFrame, targets: DataFrame, target_step: str, source_step: str, sources: DataFrame) -> DataFrame:
    """Actionable targets that have any source."""
    todo = actionable(expected, targets, target_step, source_step, sources)
    some = sources_of(todo, target_step, source_step).join(sources.select("at").distinct(), "at", "left_semi").select(F.col("target").alias("at"))
    return todo.join(some, "at", "left_semi")
