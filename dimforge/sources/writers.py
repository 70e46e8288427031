"""Tables in a folder per table, whose files are named by one pointer: all of it or some periods are replaced in one step."""

from __future__ import annotations

import fnmatch
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimforge.schema.model import order_by_dependency
from dimforge.sources import fs


class Warehouse:
    """Parquet tables below `root`. One writer per table at a time, any number of readers.

    A table's folder has data folders (below a folder per period, if it has periods), never changed once written, and versions: `_version-N` is a small text that
    says which data folder holds each period (the period "" is a whole, unpartitioned table). A version comes
    to be by renaming a complete file into its place, which is the commit; readers take the latest. A writer that dies before
    leaves data nobody refers to, which :meth:`vacuum` removes; there is no moment without the table.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _version(self, name: str) -> tuple[int, dict]:
        """The latest version's number and what it says; (0, {}) before the first."""
        found = fs.glob(self.spark, f"{self.path(name)}/_version-*")
        if not found:
            return 0, {}
        return int(found[-1].rsplit("-", 1)[1]), json.loads(fs.cat(self.spark, found[-1]))

    def _publish(self, name: str, number: int, said: dict) -> None:
        staged = f"{self.path(name)}/_next-{uuid.uuid4().hex}"
        fs.write(self.spark, json.dumps(said, sort_keys=True), staged)
        fs.rename(self.spark, staged, f"{self.path(name)}/_version-{number:010d}")

    def exists(self, name: str) -> bool:
        return self._version(name)[0] > 0

    def tables(self, include: str = "*", exclude: Iterable[str] = ()) -> list[str]:
        names = [p.rstrip("/").rsplit("/", 1)[-1] for p in fs.glob(self.spark, f"{self.root}/*")]
        named = [n for n in names if not n.startswith(("_", ".")) and fnmatch.fnmatchcase(n, include) and not any(fnmatch.fnmatchcase(n, x) for x in exclude)]
        return [n for n in named if self.exists(n)]

    def read(self, name: str) -> DataFrame:
        _, said = self._version(name)
        if not said:
            raise FileNotFoundError(self.path(name))
        folders = [f"{self.path(name)}/{w}" for _, w in sorted(said["periods"].items())]
        if not folders:
            return self.spark.createDataFrame([], said["schema"])
        return self.spark.read.schema(said["schema"]).option("basePath", self.path(name)).parquet(*folders)

    def replace(self, name: str, df: DataFrame, order: Iterable[str] = ()) -> None:
        """The whole table; `df` may read the table itself. Rows lie in ranges of the columns `order`, sorted: scans skip what filters on these rule out."""
        order = list(order)
        if order:
            df = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
        where = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path(name)}/{where}")
        self._publish(name, self._version(name)[0] + 1, {"schema": _ddl(df), "by": None, "periods": {"": where}})

    def replace_periods(self, name: str, df: DataFrame, period: str = "period") -> list[str]:
        """Just the periods that `df` has rows of, all in one step. Returns them."""
        mark, base = uuid.uuid4().hex, self.path(name)
        typed = df.withColumn(period, F.col(period).cast("string"))
        typed.write.partitionBy(period).parquet(f"{base}/_written-{mark}")
        new = {}
        for p in fs.glob(self.spark, f"{base}/_written-{mark}/{period}=*"):
            folder = p.rstrip("/").rsplit("/", 1)[1]
            fs.mkdir(self.spark, f"{base}/{folder}")
            fs.rename(self.spark, p, f"{base}/{folder}/data-{mark}")  # seen by nobody until the version says so
            new[fs.unescaped(folder.split("=", 1)[1])] = f"{folder}/data-{mark}"
        fs.remove(self.spark, f"{base}/_written-{mark}")
        number, said = self._version(name)
        if said and said["by"] != period:
            raise ValueError(f"{name} isn't kept by {period}")
        self._publish(name, number + 1, {"schema": _ddl(typed), "by": period, "periods": {**said.get("periods", {}), **new}})
        return sorted(new)

    def vacuum(self, name: str) -> None:
        """Remove older versions, and data the latest one doesn't refer to. Readers of older versions must have finished."""
        number, said = self._version(name)
        live = {f"_version-{number:010d}", *said.get("periods", {}).values()}
        below = [p for p in fs.glob(self.spark, f"{self.path(name)}/*") + fs.glob(self.spark, f"{self.path(name)}/*=*/*")]
        for p in below:
            own = p.rstrip("/").removeprefix(fs.plain(self.path(name))).strip("/")
            if own not in live and not any(w.startswith(own + "/") for w in live):
                fs.remove(self.spark, p)

    def create_database(self, name: str) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` LOCATION '{self.root}/{name}.db'")

    def drop_database(self, name: str) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")

    def define(self, tables: Iterable) -> None:
        """Empty tables for those that aren't there yet, seed rows included; what a table refers to comes first."""
        given = {t.full_name: t for t in tables}
        names = order_by_dependency({n: [r.table.full_name for r in t.references if r.table.full_name in given] for n, t in given.items()})
        for t in (given[n] for n in names):
            if not self.exists(t.full_name):
                rows = t.seed()
                schema = t.schema()
                names = schema.fieldNames()
                data = [tuple(i + 1 if n == "id" and "id" not in r else r.get(n) for n in names) for i, r in enumerate(rows)]
                for f in schema.fields:
                    f.nullable = True
                self.replace(t.full_name, self.spark.createDataFrame(data, schema).coalesce(1))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
