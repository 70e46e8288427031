import os
from datetime import datetime
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from dimforge.operators import incremental as inc

LOG = "run_id int, table_name string, window_start timestamp_ntz, window_end timestamp_ntz, status string, logged_at timestamp_ntz"


def d(day, hour=0):
    return datetime(2024, 1, day, hour)


def test_windows(spark, tmp_path):
    log = spark.createDataFrame(
        [
            (1, "t", d(1), d(3), "started", d(3, 1)), (1, "t", d(1), d(3), " Succeeded ", d(3, 2)),
            (2, "t", d(2), d(5), "succeeded", d(5, 1)), (2, "t", d(2), d(5), "rolled_back", d(5, 2)),
            (3, "t", d(6), d(7), "SUCCEEDED", d(7)), (4, "t", d(3), d(4), "succeeded", d(4)), (5, "other", d(1), d(30), "succeeded", d(30)),
            (6, "t", d(9), None, "succeeded", d(9)), (7, "t", d(9), d(8), "succeeded", d(9)),
        ],
        LOG,
    )
    rows = [(i, t) for i, t in enumerate([d(1), d(2, 23), d(3), d(4), d(5), d(6), d(6, 12), d(7), datetime(2023, 1, 1), datetime(2025, 1, 1), None])]
    df = spark.createDataFrame(rows + rows[:1], "id int, at timestamp_ntz")
    fresh = lambda n: inc.Manifest(spark, f"{tmp_path}/{n}")
    got = sorted(r.row_id for r in inc.pending_rows(df, "t", "id", "at", log, fresh("a")).collect())
    assert got == [3, 4, 7, 8, 9, 10]
    assert inc.pending_rows(df, "unheard_of", "id", "at", log, fresh("b")).count() == 12
    assert inc.pending_rows(df, "t", "id", "at", log.limit(0), fresh("c")).count() == 12
    assert inc.pending_rows(df.limit(0), "t", "id", "at", log, fresh("d")).count() == 0
    # The same rows again: as recorded. One row more in a slice that was taken in: the whole slice is due again.
    assert sorted(r.row_id for r in inc.pending_rows(df, "t", "id", "at", log, fresh("a")).collect()) == got
    late = df.unionByName(spark.createDataFrame([(99, d(6, 1))], df.schema))
    assert sorted(r.row_id for r in inc.pending_rows(late, "t", "id", "at", log, fresh("a")).collect()) == sorted([*got, 5, 6, 99])
    other = df.where("id <> 6").unionByName(spark.createDataFrame([(66, d(6, 12))], df.schema))  # as many rows, of another content
    assert sorted(r.row_id for r in inc.pending_rows(other, "t", "id", "at", log, fresh("a")).collect()) == sorted([*got, 5, 66])


def test_files_once_each(spark, tmp_path):
    src, out, clock = tmp_path / "in", f"{tmp_path}/out", iter(range(1, 100))
    src.mkdir()
    reads = []

    def write(rows, name):
        spark.createDataFrame(rows, "id int, v string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/w")
        (part,) = (tmp_path / "w").glob("*.parquet")
        part.replace(src / name)
        os.utime(src / name, (1_700_000_000 + (n := next(clock)), 1_700_000_000 + n))

    def read(paths):
        reads.append(len(paths))
        return spark.read.schema("id int, v string").parquet(*paths)

    m = inc.Manifest(spark, f"{tmp_path}/manifest")
    work = lambda df: df.select("*", F.col("_metadata.file_path").alias("input_id"))
    run = lambda: inc.run(read, [str(src)], m, out, work)
    rows = lambda: sorted((r.id, r.v) for r in inc.result(m, out).collect())

    assert run() is None and inc.result(m, out) is None  # nothing there
    write([(1, "a"), (2, "b")], "one 1%.parquet")
    assert run() and rows() == [(1, "a"), (2, "b")]
    reads.clear()
    assert run() is None and reads == []  # nothing new: nothing is read

    write([(3, "c")], "two.parquet")
    publish, m.publish = m.publish, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        run()  # written, but not committed
    assert rows() == [(1, "a"), (2, "b")]
    m.publish = publish
    write([(4, "d")], "three.parquet")  # and another file comes before the next run
    assert run() and rows() == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert len(list((tmp_path / "out").glob("batch_id=*"))) == 2  # what the lost run wrote is gone

    write([(1, "a"), (2, "b"), (5, "e")], "one 1%.parquet")  # grown
    assert run() and rows() == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]
    write([(2, "b")], "one 1%.parquet")  # shrunk
    assert run() and rows() == [(2, "b"), (3, "c"), (4, "d")]
    write([(1, "a"), (2, "b")], "one 1%.parquet")  # as it was at first
    assert run() and rows() == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    os.utime(src / "two.parquet", (1_800_000_000, 1_800_000_000))  # only touched
    assert run() is None and rows() == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    reads.clear()
    assert run() is None and reads == []
    write([], "three.parquet")  # emptied
    assert run() and rows() == [(1, "a"), (2, "b"), (3, "c")]
    (src / "two.parquet").unlink()  # what it gave stays
    assert run() is None and rows() == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(unquote(r.input_id).rsplit("/", 1)[1] for r in m.read().collect()) == ["one 1%.parquet", "three.parquet", "two.parquet"]
    with pytest.raises(FileExistsError):
        m.commit(m.read(), 1)  # another writer was first


def test_checksum_sees_content(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, v string").coalesce(1).write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(1, "b")], "id int, v string").coalesce(1).write.parquet(f"{tmp_path}/b")
    sums = {r.checksum for r in inc.checksums(spark.read.parquet(f"{tmp_path}/a", f"{tmp_path}/b")).collect()}
    assert len(sums) == 2


def test_checksum_sees_maps(spark, tmp_path):
    kinds = "id int, m map<string,string>, n array<struct<a:int,m:map<string,map<string,int>>>>"
    rows = [(1, {"k": "a"}, [(1, {"x": {"y": 1}})]), (1, {"k": "b"}, [(1, {"x": {"y": 1}})]), (1, {"k": "a"}, [(1, {"x": {"y": 2}})]), (1, None, [None])]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], kinds).coalesce(1).write.parquet(f"{tmp_path}/{i}")
    assert len({r.checksum for r in inc.checksums(spark.read.parquet(*[f"{tmp_path}/{i}" for i in range(4)])).collect()}) == 4
    one, other = ("map('k', 'a', 'l', 'b')", "map('l', 'b', 'k', 'a')")
    for name, m in (("p", one), ("q", other)):
        spark.sql(f"select 1 as id, {m} as m").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    assert len({r.checksum for r in inc.checksums(spark.read.parquet(f"{tmp_path}/p", f"{tmp_path}/q")).collect()}) == 1
