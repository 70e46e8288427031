"""Processing only what is new or changed since the last successful run.

A manifest lists the inputs that committed runs have taken in, with size and checksum, and the batch
that holds what was made of each. A run lists the inputs there are now without reading them, hashes
only those whose size or time differ from the manifest, anti-joins these against it by checksum,
writes its output under a batch identifier and commits the manifest last, by one rename. Readers see
an input's rows only in the batch the manifest names for it, so what a run left behind that died
before its commit, and what an input gave before it changed, is never seen.

An input is a file, or a slice of a table by modification time between two boundaries that the
log of earlier loads names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimforge.functions.merge import comparable
from dimforge.functions.names import col, require
from dimforge.session import materialise
from dimforge.sources import fs


def hashable(c: Column, kind: T.DataType) -> Column:
    """`c` with every map in it, at any depth, as its entries in key order, which can be hashed."""
    if "map<" not in kind.simpleString():
        return c
    if isinstance(kind, T.MapType):
        return comparable(F.transform_values(c, lambda k, v: hashable(v, kind.valueType)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: hashable(x, kind.elementType))
    return F.when(c.isNotNull(), F.struct(*[hashable(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))


def checksums(df: DataFrame) -> DataFrame:
    """Per file behind `df`: `input_id` (its path), `rows` and `checksum`, the sum of the hashes of its rows.

    The work is spread over the splits of the files and combined on the map side, so a file of any size
    is fine. Maps are hashed by their entries in key order. A file without rows has none here.
    """
    h = F.xxhash64(*[hashable(col(f.name), f.dataType) for f in df.schema]).cast("decimal(20,0)")
    m = df.select(F.col("_metadata.file_path").alias("input_id"), h.alias("h"))
    return m.groupBy("input_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("h").cast("string").alias("checksum"))


def pending(listing: DataFrame, manifest: DataFrame, compare: tuple[str, ...] = ("size", "checksum"), keys: tuple[str, ...] = ("input_id",)) -> DataFrame:
    """Entries of `listing` that `manifest` doesn't have with the same `keys` and the same `compare` columns (null equals null)."""
    on = F.lit(True)
    for k in [*keys, *compare]:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"m.{k}"))
    return listing.alias("l").join(manifest.alias("m"), on, "left_anti")


def succeeded_windows(log: DataFrame) -> DataFrame:
    """`table_name`, `window_start`, `window_end` of the runs whose latest log row says succeeded.

    Letter case and surrounding blanks of the status are ignored; of equal times the greatest status
    in the alphabet counts. Windows without both ends, or that end before they start, take in nothing.
    """
    require(log, "run_id", "table_name", "window_start", "window_end", "status", "logged_at")
    row = F.struct("logged_at", F.lower(F.trim("status")).alias("status"), "table_name", "window_start", "window_end")
    last = log.groupBy("run_id").agg(F.max(row).alias("r")).where(F.col("r.status") == "succeeded")
    return last.select("r.table_name", "r.window_start", "r.window_end").where("window_start < window_end")


def merged_windows(windows: DataFrame) -> DataFrame:
    """What `windows` cover, as slices: `table_name`, `input_id`, `slice_start`, `slice_end`.

    Overlapping and touching windows are merged first, so slices of a table never overlap.
    """
    w = Window.partitionBy("table_name").orderBy("window_start", "window_end")
    reached = F.max("window_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = windows.select("*", F.when(reached >= F.col("window_start"), 0).otherwise(1).alias("o"))
    runs = opens.select("*", F.sum("o").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("g"))
    merged = runs.groupBy("table_name", "g").agg(F.min("window_start").alias("slice_start"), F.max("window_end").alias("slice_end"))
    ident = F.concat_ws("/", F.col("slice_start").cast("string"), F.col("slice_end").cast("string"))
    return merged.select("table_name", ident.alias("input_id"), "slice_start", "slice_end")


def slices(taken: DataFrame) -> DataFrame:
    """All slices of every table: those `taken` in and the gaps before, between and after them.

    The open ends are null. One row per slice: `table_name`, `input_id`, `slice_start`, `slice_end` and `taken`.
    """
    w = Window.partitionBy("table_name").orderBy("slice_start")
    m = taken.select("table_name", "input_id", "slice_start", "slice_end", F.lag("slice_end").over(w).alias("before"), F.lead("slice_start").over(w).alias("after"))
    gap = F.when(F.col("before").isNull() | (F.col("before") < F.col("slice_start")), F.struct(F.concat(F.lit("before/"), "input_id").alias("input_id"), F.col("before").alias("slice_start"), F.col("slice_start").alias("slice_end"), F.lit(False).alias("taken")))
    tail = F.when(F.col("after").isNull(), F.struct(F.concat(F.lit("after/"), "input_id").alias("input_id"), F.col("slice_end").alias("slice_start"), F.lit(None).cast("timestamp_ntz").alias("slice_end"), F.lit(False).alias("taken")))
    own = F.struct("input_id", "slice_start", "slice_end", F.lit(True).alias("taken"))
    return m.select("table_name", F.explode(F.array_compact(F.array(gap, own, tail))).alias("s")).select("table_name", "s.*")


def in_slices(rows: DataFrame, table_name: str, modified: str, known: DataFrame) -> DataFrame:
    """`rows` with `input_id`: the slice their `modified` time lies in; null where it has none (no time, or no slice of the table).

    Closed slices are cut by day, so that rows find theirs by an equality on the day; the list is a few
    rows per day of the log, not of the data. The open ends, one each, are compared directly.
    """
    mine = known.where(F.col("table_name") == table_name)
    closed = mine.where("slice_start is not null and slice_end is not null")
    # The last day is the one before the (excluded) end.
    days = F.sequence(F.to_date("slice_start"), F.to_date(F.expr("slice_end - interval 1 microsecond")))
    daily = closed.select(F.explode(days).alias("__day"), F.col("input_id").alias("__slice"), F.col("slice_start").alias("__from"), F.col("slice_end").alias("__to"))
    head = mine.where("slice_start is null").agg(F.max(F.struct("slice_end", "input_id")).alias("h")).scalar()
    tail = mine.where("slice_end is null").agg(F.max(F.struct("slice_start", "input_id")).alias("t")).scalar()
    t = col(modified)
    on = (F.to_date(t) == F.col("__day")) & (t >= F.col("__from")) & (t < F.col("__to"))
    joined = rows.join(daily, on, "left")
    ident = F.when(F.col("__slice").isNotNull(), F.col("__slice")).when(t < head["slice_end"], head["input_id"]).when(t >= tail["slice_start"], tail["input_id"])
    return joined.select(*[col(c) for c in rows.columns], ident.alias("input_id"))


class Slices:
    """A table's rows as inputs by modification time, against a manifest.

    `log` (see :func:`succeeded_windows`) names the boundaries. They are worked out once, into a small
    table in the shared folder: some rows per run of the log, none per row of the data.
    """

    def __init__(self, rows: DataFrame, table_name: str, modified: str, log: DataFrame):
        require(rows, modified)
        self.rows, self.table_name, self.modified = rows, table_name, modified
        taken = merged_windows(succeeded_windows(log.where(F.col("table_name") == table_name)))
        self.known = materialise(slices(taken), "slices")

    def placed(self) -> DataFrame:
        return in_slices(self.rows, self.table_name, self.modified, self.known)

    def listing(self) -> DataFrame:
        """Every slice that holds rows: `input_id`, `size` (rows) and `checksum` (of whole rows), combined on the map side.

        Rows without a time, and those of a table without any slice, are the input null.
        """
        h = F.xxhash64(*[hashable(col(f.name), f.dataType) for f in self.rows.schema]).cast("decimal(20,0)")
        return self.placed().select("input_id", h.alias("h")).groupBy("input_id").agg(F.count(F.lit(1)).alias("size"), F.sum("h").cast("string").alias("checksum"))

    def adopt(self, listing: DataFrame, manifest: Manifest) -> None:
        """Record, as the first batch of an empty manifest, what the runs of the log have taken in."""
        if not manifest.versions():
            own = self.known.where("taken").select(F.col("input_id").alias("__id"))
            taken = listing.join(own, F.col("input_id") == F.col("__id"), "left_semi")
            manifest.commit(taken.select("input_id", "size", F.lit(None).cast("long").alias("mtime"), F.col("size").alias("rows"), "checksum", F.lit("log").alias("batch_id")), 1)

    def pending(self, listing: DataFrame, manifest: DataFrame) -> DataFrame:
        """The rows of slices that the manifest doesn't have with this size and checksum."""
        left = pending(listing, manifest).select(F.col("input_id").alias("__id"))
        return self.placed().join(left, F.col("input_id").eqNullSafe(F.col("__id")), "left_semi").select(*[col(c) for c in self.rows.columns])


def pending_rows(rows: DataFrame, table_name: str, key: str, modified: str, log: DataFrame, manifest: Manifest) -> DataFrame:
    """Rows that the next run has to take in: `table_name`, `row_id`.

    Where `manifest` is empty, the slices that succeeded runs of `log` took in are recorded in it first,
    with size and checksum. Then all slices that hold rows are listed, the listing is anti-joined against
    the manifest by size and checksum, and the rows of the slices left are given: of new slices, and of
    recorded ones whose rows are no longer those that were taken in. Rows without a time were in no window,
    so they are given too, as are all rows of a table the log doesn't name. Nothing is recorded for
    them: that is up to the run that takes them in.
    """
    s = Slices(rows.select(col(key).alias("row_id"), col(modified).alias("modified")), table_name, "modified", log)
    listing = materialise(s.listing(), "listing")
    s.adopt(listing, manifest)
    return s.pending(listing, manifest.read()).select(F.lit(table_name).alias("table_name"), F.col("row_id").cast("long").alias("row_id"))


class Manifest:
    """Committed inputs, as Parquet under `path`, one folder per version.

    A version is staged beside its place and renamed into it, which is the commit; a second writer of the
    same version fails. Of an input the entry of the latest version counts.
    """

    SCHEMA = "input_id string, size bigint, mtime bigint, rows bigint, checksum string, batch_id string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        return sorted(int(p.rstrip("/").rsplit("=", 1)[1]) for p in fs.glob(self.spark, f"{self.path}/version=*"))

    def read(self) -> DataFrame:
        """The entry that counts of every input."""
        have = [f"{self.path}/version={v:08d}" for v in self.versions()]
        if not have:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(f"{self.SCHEMA}, version int").option("basePath", self.path).parquet(*have)
        names = [f.name for f in rows.schema if f.name not in ("input_id", "version")]
        last = rows.groupBy("input_id").agg(F.max_by(F.struct(*names), "version").alias("e"))
        return last.select("input_id", "e.*")

    def stage(self, entries: DataFrame, version: int) -> DataFrame:
        """`entries`, written beside the place of `version`."""
        staged = f"{self.path}/_staged-{version:08d}"
        entries.select(*[col(f.strip().split()[0]) for f in self.SCHEMA.split(",")]).write.mode("overwrite").parquet(staged)
        return self.spark.read.schema(self.SCHEMA).parquet(staged)

    def publish(self, version: int) -> None:
        fs.rename(self.spark, f"{self.path}/_staged-{version:08d}", f"{self.path}/version={version:08d}")

    def commit(self, entries: DataFrame, version: int) -> None:
        self.stage(entries, version)
        self.publish(version)


def run(read: Callable[[list[str]], DataFrame], roots: list[str], manifest: Manifest, out: str, work: Callable[[DataFrame], DataFrame]) -> str | None:
    """One incremental run: what `work` makes of the new and changed files below `roots` goes to `out`.

    `read` gives the data of the named files. What `work` makes of it must have a column `input_id`, the
    `_metadata.file_path` of the file each row comes from: by that a file's rows are found again when it has changed. Returns the batch identifier, or None when
    nothing was new. Read the result with :func:`result`. A run that died at any point leaves nothing
    that readers see, and its files are taken in by the next run; a file that changed is taken in whole
    again and replaces what it gave before; files that are gone keep what they gave. One writer at a
    time: a second one fails at its commit. A file whose size and time (milliseconds) are unchanged is not read.
    The paths of new files are gathered to the driver, where Spark's file index holds them anyway.
    """
    spark = manifest.spark
    done = manifest.versions()
    version = (done[-1] if done else 0) + 1
    known = manifest.read()
    for p in fs.glob(spark, f"{out.rstrip('/')}/batch_id=*"):  # of a run that died before its commit
        if p.rstrip("/").rsplit("=", 1)[1].split("-")[0] >= f"{version:08d}":
            fs.remove(spark, p)
    touched = materialise(pending(list_files(spark, *roots), known, ("size", "mtime")), "touched")
    paths = [unquote(r[0]) for r in touched.select("input_id").collect()]
    if not paths:
        return None
    hashed = touched.join(checksums(read(paths)), "input_id", "left").na.fill({"rows": 0, "checksum": "0"})
    batch = f"{version:08d}-{hashlib.sha256(chr(0).join(sorted(paths)).encode()).hexdigest()[:16]}"
    before = known.select(F.col("input_id").alias("__id"), F.col("size").alias("__size"), F.col("checksum").alias("__sum"), F.col("batch_id").alias("__batch"))
    same = F.col("__size").eqNullSafe(F.col("size")) & F.col("__sum").eqNullSafe(F.col("checksum"))
    # A file that was only touched keeps its batch; its new time is recorded.
    entries = manifest.stage(hashed.join(before, F.col("input_id") == F.col("__id"), "left").withColumn("batch_id", F.when(same, F.col("__batch")).otherwise(F.lit(batch))), version)
    new = [unquote(r[0]) for r in entries.where(F.col("batch_id") == batch).select("input_id").collect()]
    if new:
        made = work(read(new))
        require(made, "input_id")
        made.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch}")
    manifest.publish(version)
    return batch if new else None


def list_files(spark: SparkSession, *roots: str) -> DataFrame:
    """All files below `roots`: `input_id` (path), `size` in bytes, `mtime` in milliseconds; listed in parallel, none is read."""
    m = fs.files_below(spark, *roots).select(*[F.col(f"_metadata.{c}") for c in ("file_path", "file_name", "file_size", "file_modification_time")])
    return m.where(~F.col("file_name").rlike("^[_.]")).select(F.col("file_path").alias("input_id"), F.col("file_size").alias("size"), F.unix_millis("file_modification_time").alias("mtime"))


def result(manifest: Manifest, out: str) -> DataFrame | None:
    """What committed runs made of the files as they were last taken in, with `input_id`; None before the first run.

    Only batches the manifest names are read, and in them only the rows of inputs whose entry names that batch.
    """
    entries = manifest.read().select(F.col("input_id").alias("__id"), F.col("batch_id").alias("__batch"))
    live = [r[0] for r in entries.select("__batch").distinct().collect()]
    have = [p for b in sorted(live) if fs.exists(manifest.spark, p := f"{out.rstrip('/')}/batch_id={b}")]
    if not have:
        return None
    rows = manifest.spark.read.option("basePath", out.rstrip("/")).parquet(*have)
    kept = rows.join(entries, (F.col("input_id") == F.col("__id")) & (F.col("batch_id") == F.col("__batch")), "left_semi")
    return kept.drop("batch_id")
