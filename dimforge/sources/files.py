"""Delimited, raw and JSON files in and out, as each kind of store writes them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimforge.functions.names import col
from dimforge.schema.model import STORES, Table
from dimforge.sources import fs

_OUTSIDE_BRACES = r"(?=(?:[^{}]*\{[^{}]*\})*[^{}]*$)"


def _existing(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """Paths that are there; folders stand for the files in them."""
    return [p for p in ([paths] if isinstance(paths, str) else dict.fromkeys(paths)) if fs.glob(spark, p)]


def read_delimited(spark: SparkSession, paths: str | Sequence[str], table: Table, store: str = "postgres", *, line_breaks: bool = True, **options: str) -> DataFrame:
    """A file's rows as text columns in the order `table` declares; comments and blank lines aside.

    Invalid UTF-8 is replaced. Quoted fields may hold separators and, unless `line_breaks` is
    false, line breaks; without them a large file is read by many tasks, with them by one. With a header, columns
    go by name; otherwise by place. Missing paths are left out; with none the result is empty.
    """
    o = STORES[store]
    schema = T.StructType([T.StructField(c.name, T.StringType()) for c in table.columns])
    have = _existing(spark, paths)
    if not have:
        return spark.createDataFrame([], schema)
    opts = {"sep": o["sep"] or "\x01", "header": str(o["header"]).lower(), "comment": "#", "encoding": "UTF-8", "quote": '"', "escape": '"', "multiLine": str(line_breaks).lower(), "enforceSchema": "true", "nullValue": "", "mode": "PERMISSIVE", **options}
    return spark.read.options(**opts).schema(schema).csv(have)


def read_raw(spark: SparkSession, paths: str | Sequence[str], column: str = "data") -> DataFrame:
    """Lines as they are, one text column; blank lines and comments aside."""
    have = _existing(spark, paths)
    if not have:
        return spark.createDataFrame([], f"`{column}` string")
    lines = spark.read.text(have)
    return lines.where((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.col("value").alias(column))


def split_outside_braces(line: Column, sep: str = ",") -> Column:
    """Fields of a line whose JSON objects aren't quoted: separators within (unnested) braces don't count."""
    return F.split(line, re.escape(sep) + _OUTSIDE_BRACES, -1)


def read_json_in_csv(spark: SparkSession, paths: str | Sequence[str], table: Table, sep: str = ",") -> DataFrame:
    """Delimited lines with raw JSON objects in them, as text columns by place."""
    parts = read_raw(spark, paths, "line").select(split_outside_braces(F.col("line"), sep).alias("f"))
    return parts.select(*[F.get("f", F.lit(i)).alias(c.name) for i, c in enumerate(table.columns)])


def read_json_lines(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    return read_raw(spark, paths).select(F.from_json("data", schema).alias("j")).select("j.*")


def read_hive(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """A folder partitioned as name=value, tab-separated, empty text null."""
    schema = T.StructType([T.StructField(c.name, T.StringType()) for c in table.columns if not c.partition])
    return spark.read.schema(schema).options(sep="\t", nullValue="", emptyValue="").csv(path)


def write_delimited(df: DataFrame, path: str, store: str = "postgres", partition: Sequence[str] = ()) -> None:
    o = STORES[store]
    w = df.write.mode("overwrite").options(sep=o["sep"] or "\t", header=str(o["header"]).lower(), quote='"', escape='"', nullValue="", emptyValue='""' if store == "postgres" else "")
    (w.partitionBy(*partition) if partition else w).csv(path)


def count_by_key(lines: DataFrame, column: str) -> DataFrame:
    """Lines counted by content: `key`, `n`; counted on the map side first."""
    return lines.groupBy(col(column).alias("key")).agg(F.count(F.lit(1)).alias("n"))
