import datetime as dt

import pytest

from dimforge import runtime
from dimforge.operators import dimensions, facts, load, mapping
from dimforge.schema.model import Column, Reference, Table
from dimforge.sources import fs
from dimforge.sources.writers import Warehouse


def test_external_program(spark):
    lines = spark.createDataFrame([("b a",), (None,), ("c",), ("é",)], "t string").repartition(2)
    assert sorted(r.line for r in mapping.pipe(lines, "t", ["tr", "a-z", "A-Z"]).collect()) == ["B A", "C", "é"]
    assert mapping.pipe(lines.limit(0), "t", ["cat"]).count() == 0
    with pytest.raises(Exception, match="ended with"):
        mapping.pipe(lines, "t", ["false"]).collect()


def test_keys_of_several_columns(spark):
    child = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a")], "x int, y string")
    parent = spark.createDataFrame([(1, "a"), (2, "b")], "p int, q string")
    assert [tuple(r) for r in mapping.missing_parents(child, ["x", "y"], parent, ["p", "q"]).collect()] == [(1, "b")]


def test_upsert_takes_the_newest(spark):
    target = spark.createDataFrame([(1, "old")], "k int, v string")
    source = spark.createDataFrame([(1, "z", 1), (1, "a", 2), (2, "n", 1)], "k int, v string, seen int")
    assert sorted(map(tuple, dimensions.upsert(target, source, ["k"], newest=["seen"]).collect())) == [(1, "a"), (2, "n")]
    assert sorted(map(tuple, dimensions.upsert(target, source, ["k"]).collect())) == [(1, "z"), (2, "n")]


def test_tables_are_chosen_and_sorted(spark, tmp_path):
    w = Warehouse(spark, f"{tmp_path}/w")
    state = Table("state", "mini", (Column("name", "string", unique=("name",)),))
    user = Table("user", "one", (Column("user_id", natural_key=True),), (Reference(state),))
    w.define([user, state])
    assert w.tables() == ["state_type", "user_dimension"] and w.tables(exclude=["*_type"]) == ["user_dimension"] and w.tables("s*") == ["state_type"]
    w.replace("n", spark.range(100, numPartitions=4).selectExpr("(id * 37) % 100 as id"), order=["id"])
    assert sorted(r.id for r in w.read("n").collect()) == list(range(100))


def test_periods_of_facts(spark):
    t = Table("visits", "fact", (Column("total", measure=True, aggregate="sum"),), grain="hourly", partition="y%Ym%m")
    got = t.periods(dt.date(2023, 12, 31), dt.date(2024, 2, 1))
    assert [n for n, _, _ in got] == ["y2023m12", "y2024m01", "y2024m02"] and got[1][1:] == (1704067200, 1706745600)
    f = spark.createDataFrame([(20240101, 1704067200, 1), (20240201, 1706745600, 2)], "date_id int, time_key long, total int")
    assert [r.total for r in facts.rollup(f, grain="daily", date_key="date_id", measures={"total": "sum"}, between=got[1][1:]).collect()] == [1]


def test_hooks():
    h, said = runtime.Hooks(), []
    for p, n in ((5, "late"), (0, "a"), (0, "b"), (-1, "first")):
        h.add("before", lambda x, n=n: said.append((n, x)), p)
    h.call("before", 1)
    assert said == [("first", 1), ("a", 1), ("b", 1), ("late", 1)] and h.call("after") == []


def test_sync(spark, tmp_path):
    (tmp_path / "a" / "x").mkdir(parents=True)
    for n, text in (("a/one", "1"), ("a/x/two", "22")):
        (tmp_path / n).write_text(text)
    go = lambda: fs.sync(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    assert go() == ["one", "x/two"] and (tmp_path / "b" / "x" / "two").read_text() == "22"
    assert go() == []
    (tmp_path / "a" / "one").write_text("longer")
    (tmp_path / "b" / "kept").write_text("k")
    assert go() == ["one"] and (tmp_path / "b" / "one").read_text() == "longer" and (tmp_path / "b" / "kept").exists()


def test_implicit_references(spark):
    state = Table("state", "mini", (Column("name", "string", unique=("name",)),))
    t = Table("visits", "fact", (Column("total", measure=True),), (Reference(state, implicit=True),), grain="hourly")
    rows = spark.createDataFrame([("on", 3)], "state_type_name string, total int")
    assert load.denormalize(rows, t, {}).columns == ["state_type_name", "total"]
