"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Applied only by :func:`build`; a session handed in by a caller is left as it is.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
}


def build(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; `master` None leaves the choice to spark-submit."""
    b = SparkSession.builder.appName("dimforge")
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (tests, a single machine) a local folder is made and set, and removed when Python ends.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="dimforge-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        d = "file://" + local
        spark.sparkContext.setCheckpointDir(d)
    return d


def work_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; :func:`clear` removes it."""
    return f"{shared_dir(spark).rstrip('/')}/dimforge-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove what :func:`materialise` has written. DataFrames made from it can't be read any more."""
    from dimforge.sources import fs

    if fs.exists(spark, work_dir(spark)):
        fs.remove(spark, work_dir(spark))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Cuts lineage so that costly work (tokenising, parsing) runs once, and gives the planner the true
    size; the files outlive lost executors. They stay until :func:`clear`.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
