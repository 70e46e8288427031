"""Files of any scheme Hadoop knows (local, HDFS, S3), through one interface.

Metadata goes through the driver's Hadoop FileSystem; nothing here reads file contents except
:func:`cat`. Modification times are cut to the minute, as freshness is decided by the minute.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimforge import session
from dimforge.runtime import in_parallel


@dataclass(frozen=True)
class Stat:
    path: str
    mtime: int
    size: int
    is_dir: bool


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _plain(path: str) -> str:
    return path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _minute(ms: int) -> int:
    """Seconds since 1970 at the beginning of the minute."""
    return ms // 60_000 * 60


def guard(path: str) -> str:
    """Refuses to let a root folder be changed or removed."""
    bare = path.split("://", 1)[-1] if "://" in path else path
    parts = [x for x in bare.split("/") if x]
    if len(parts) < (2 if "://" in path and not path.startswith("file://") else 1):
        raise ValueError(f"refusing to change a root path: {path}")
    return path


def unescaped(name: str) -> str:
    """A partition's value from its folder's name."""
    return unquote(name)


def plain(path: str) -> str:
    """`path` as :func:`glob` gives it."""
    return _plain(path[7:] if path.startswith("file:///") else path)


def exists(spark: SparkSession, path: str) -> bool:
    f, p = _at(spark, path)
    return f.exists(p)


def glob(spark: SparkSession, pattern: str) -> list[str]:
    return [s.path for s in glob_stat(spark, pattern)]


def glob_stat(spark: SparkSession, pattern: str) -> list[Stat]:
    """Matches of `pattern` by name order; [] when there is none."""
    f, p = _at(spark, pattern)
    found = f.globStatus(p) or []
    return sorted((Stat(_plain(s.getPath().toString()), _minute(s.getModificationTime()), s.getLen(), s.isDirectory()) for s in found), key=lambda s: s.path)


def glob_sort(spark: SparkSession, pattern: str) -> list[str]:
    """Matches ordered by their last path part."""
    return sorted(glob(spark, pattern), key=lambda p: (p.rstrip("/").rsplit("/", 1)[-1], p))


def stat(spark: SparkSession, path: str) -> Stat | None:
    """Of a folder: the latest time and the summed size of the files below it. None if it isn't there."""
    f, p = _at(spark, path)
    if not f.exists(p):
        return None
    s = f.getFileStatus(p)
    if s.isFile():
        return Stat(path, _minute(s.getModificationTime()), s.getLen(), False)
    latest, size, it = s.getModificationTime() if not f.listStatus(p) else 0, 0, f.listFiles(p, True)
    while it.hasNext():
        x = it.next()
        latest, size = max(latest, x.getModificationTime()), size + x.getLen()
    return Stat(path, _minute(latest), size, True)


def files_below(spark: SparkSession, *roots: str) -> DataFrame:
    """All files below `roots`: path, modificationTime, length; listed by Spark's own parallel file index.

    Contents aren't read. Empty files hold nothing to process and aren't listed; :func:`glob_stat` sees them.
    """
    have = [r for r in roots if exists(spark, r)]
    if not have:
        have = [f"{session.work_dir(spark)}/none"]
        mkdir(spark, *have)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(have).select("path", "modificationTime", "length")


def listing(spark: SparkSession, *roots: str) -> DataFrame:
    """:func:`files_below` as path, mtime (by the minute), size."""
    return files_below(spark, *roots).selectExpr("path", "date_trunc('minute', modificationTime) as mtime", "length as size")


def mkdir(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        f, p = _at(spark, path)
        f.mkdirs(p)


def touch(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        f, p = _at(spark, guard(path))
        if f.exists(p):
            f.setTimes(p, spark._jvm.System.currentTimeMillis(), -1)
        else:
            f.create(p).close()


def write(spark: SparkSession, text: str, path: str) -> None:
    f, p = _at(spark, guard(path))
    out = f.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def cat(spark: SparkSession, *paths: str) -> str:
    """Contents of small text files, one after the other."""
    got = []
    for path in paths:
        f, p = _at(spark, path)
        s = f.open(p)
        try:
            got.append(spark._jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8"))
        finally:
            s.close()
    return "".join(got)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Between any two schemes; into `target` if that is a folder."""
    (f, p), (g, q) = _at(spark, source), _at(spark, guard(target))
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(f, p, g, q, False, True, spark._jsc.hadoopConfiguration())


def move(spark: SparkSession, source: str, target: str) -> None:
    (f, p), (g, q) = _at(spark, guard(source)), _at(spark, guard(target))
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(f, p, g, q, True, True, spark._jsc.hadoopConfiguration())


def sync(spark: SparkSession, source: str, target: str, *, workers: int = 8) -> list[str]:
    """Copy the files below `source` that `target` doesn't have with the same size, or has older; the paths copied, below `source`.

    Both sides are listed in parallel without being read, and compared as tables. Nothing is removed from `target`;
    empty files aren't copied.
    """
    mkdir(spark, guard(target))
    here, there = (x.rstrip("/") for x in (source, target))
    below = lambda root: files_below(spark, root).select(F.expr(f"substring(path, instr(path, '{plain(root).rstrip('/')}/') + {len(plain(root).rstrip('/')) + 1})").alias("p"), "length", "modificationTime")
    a, b = below(here).alias("a"), below(there).alias("b")
    old = (F.col("a.p") == F.col("b.p")) & (F.col("a.length") == F.col("b.length")) & (F.col("a.modificationTime") <= F.col("b.modificationTime"))
    todo = sorted(r[0] for r in a.join(b, old, "left_anti").select("a.p").collect())

    def one(p: str) -> None:
        mkdir(spark, f"{there}/{p}".rsplit("/", 1)[0])
        copy(spark, f"{here}/{p}", f"{there}/{p}")

    in_parallel(one, [{"p": p} for p in todo], workers)
    return todo


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Within one file system, as one step; fails if `target` is there."""
    f, p = _at(spark, guard(source))
    q = spark._jvm.org.apache.hadoop.fs.Path(guard(target))
    if f.exists(q) or not f.rename(p, q):
        raise FileExistsError(target)


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        f, p = _at(spark, guard(path))
        f.delete(p, True)
