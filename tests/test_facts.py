from datetime import datetime

import pytest

from dimforge.operators import facts, mapping
from dimforge.operators.facts import Member
from dimforge.schema.model import Column, Table, order_by_dependency


def d(day):
    return datetime(2024, 1, day)


def sec(day):
    return int((d(day) - datetime(1970, 1, 1)).total_seconds())


def test_temporal(spark):
    users = spark.createDataFrame([(1, 7, d(2), d(5), 1), (2, 7, d(5), None, 2)], "id long, user int, start_at timestamp_ntz, end_at timestamp_ntz, version int")
    src = spark.createDataFrame([(7, sec(1), "early"), (7, sec(3), "first"), (7, sec(5), "edge"), (7, sec(9), "open"), (8, sec(3), "nobody"), (None, sec(3), "null")], "u int, time_key long, tag string")
    find = lambda **k: sorted((r.tag, r.user_id) for r in facts.stage_fact(src, [Member("user_id", users, {"user": "u"}, temporal=True, **k)], time_key="time_key", keep=["tag"]).collect())
    assert find() == [("early", 1), ("edge", 1), ("edge", 2), ("first", 1), ("open", 2)]
    assert find(half_open=True, unknown=-2) == [("early", 1), ("edge", 2), ("first", 1), ("nobody", -2), ("null", -2), ("open", 2)]
    assert find(sequential=True) == find() and find(sequential=True, half_open=True, unknown=-2) == find(half_open=True, unknown=-2)
    assert find(sequential=True, unknown=-2) == find(unknown=-2)
    with pytest.raises(ValueError):
        facts.stage_fact(src, [Member("user_id", users, {"user": "u"}, temporal=True)])


def test_sequential_versions_with_gaps(spark):
    """Ends before the next begins, a first version that isn't numbered 1, two keys, and times at every edge: as the plain join has it."""
    rows = [(1, 7, "x", d(2), d(4), 1), (2, 7, "x", d(6), d(8), 2), (3, 7, "x", d(8), None, 3), (4, 7, "y", d(5), d(6), 2), (5, None, "y", d(1), None, 1)]
    users = spark.createDataFrame(rows, "id long, user int, place string, start_at timestamp_ntz, end_at timestamp_ntz, version int")
    src = spark.createDataFrame([(u, p, sec(n), f"{u}{p}{n}") for u in (7, 8, None) for p in ("x", "y", None) for n in range(1, 11)], "u long, p string, time_key long, tag string")
    for more in ({}, {"unknown": -2}, {"half_open": True}, {"half_open": True, "unknown": -2}):
        got = [sorted((r.tag, r.user_id) for r in facts.stage_fact(src, [Member("user_id", users, {"user": "u", "place": "p"}, temporal=True, sequential=q, **more)], time_key="time_key", keep=["tag"]).collect()) for q in (False, True)]
        assert got[0] == got[1] and got[0], more


def test_through_default_degenerate_and_cycles(spark):
    groups = spark.createDataFrame([(1, 5, 100)], "id long, grp int, tenant int")
    tenants = spark.createDataFrame([(11, 100), (12, 200)], "id long, tenant int")
    src = spark.createDataFrame([(5, None, "s1"), (5, 200, "s2")], "g int, t int, session string")
    refs = [Member("tenant_id", tenants, {"tenant": "t"}, name="tenant", through={"tenant": [("grp", "tenant")]}), Member("group_id", groups, {"grp": "g"}, name="grp"), Member("session_id", on={"": "session"}, degenerate=True)]
    got = facts.stage_fact(src, refs)
    assert got.columns == ["tenant_id", "group_id", "session_id"]
    assert sorted(map(tuple, got.collect())) == [(11, 1, "s1"), (12, 1, "s2")]
    with pytest.raises(ValueError):
        order_by_dependency({"a": ["b"], "b": ["a"]})


def test_rollup(spark):
    df = spark.createDataFrame([(20240131, 1, sec(31) + 3599, 5, 2.0), (20240131, 1, sec(31), 7, 4.0), (20240201, 1, sec(31) + 86400, 1, 9.0), (None, 1, None, 3, 1.0)], "date_id int, u int, time_key long, total int, v double")
    m = {"total": "sum", "v": "average"}
    hourly = facts.rollup(df, grain="hourly", date_key="date_id", keys=["u"], measures=m)
    assert sorted((r.date_id, r.time_key, r.total, r.v) for r in hourly.collect() if r.date_id) == [(20240131, sec(31), 12, 3.0), (20240201, sec(31) + 86400, 1, 9.0)]
    monthly = facts.rollup(hourly, grain="monthly", date_key="date_id", keys=["u"], measures=m)
    assert sorted((r.date_id, r.time_key, r.total) for r in monthly.collect() if r.date_id) == [(20240101, sec(1), 12), (20240201, sec(31) + 86400, 1)]
    dates = spark.createDataFrame([(1, 20240131)], "id int, date_id int")
    keyed = spark.createDataFrame([(1, 5), (2, 6)], "date_key int, total int")
    looked_up = facts.rollup(keyed, grain="daily", date_key="date_key", measures={"total": "max"}, members=dates)
    assert [(r.date_key, r.total, r.time_key) for r in looked_up.collect()] == [(20240131, 5, sec(31))]
    with pytest.raises(ValueError):
        facts.rollup(df, grain="weekly", date_key="date_id", measures=m)
    with pytest.raises(ValueError):
        facts.rollup(df, grain="daily", date_key="date_id", measures={"total": "median"})
    assert facts.rollup(df.limit(0), grain="daily", date_key="date_id", measures=m).count() == 0


TABLE = Table("user", "table", (Column("id", "long"), Column("name", "string", null=True), Column("admin", "boolean", default=False), Column("kind", "enum", values=("a", "b"), null=True), Column("at", "timestamp", null=True), Column("prefs", "json", null=True), Column("tags", "string", array=True, null=True)))


def test_coercion_and_rejects(spark):
    rows = [("1", " x ", "TRUE", "a", "1706746155", '{"a": 1}', '["p","q"]'), ("2x", "", "", None, "2024-01-01T00:00:00", None, "solo"), (None, "n", "1", "a", None, "", None), ("3", None, "maybe", "z", "never", "[1", "")]
    df = spark.createDataFrame(rows, "id string, name string, admin string, kind string, at string, prefs string, tags string").selectExpr("*", "1 as undeclared")
    good, bad = mapping.split(mapping.coerced(df, TABLE))
    got = sorted(map(tuple, good.collect()), key=str)
    assert got[0][:3] == (1, " x ", True) and str(got[0][4]) == "2024-02-01 00:09:15" and got[0][6] == ["p", "q"]
    assert got[1][:4] == (2, None, False, None) and got[1][6] == ["solo"]
    assert sorted(r.reject for r in bad.collect()) == ["could not coerce admin", "missing id"]
    with pytest.raises(Exception, match="missing id|could not coerce"):
        mapping.split(mapping.coerced(df, TABLE), fail_fast=True)[0].collect()


def test_python_map(spark):
    def f(row, line):
        if row["v"] == "boom":
            raise KeyError("v")
        return [{"v": row["v"], "line": line}] * 2 if row["v"] else None

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("v", T.StringType()), T.StructField("line", T.LongType())])
    df = spark.createDataFrame([("a", 1), ("boom", 2), ("", 3)], "v string, no int")
    got = mapping.apply(df, f, schema, line="no").collect()
    assert sorted((str(r.v), str(r.line), bool(r.error)) for r in got) == [("None", "None", True), ("a", "1", False), ("a", "1", False)]
    assert mapping.apply(df, f, schema, line="no", distinct=True).count() == 2
    assert mapping.apply(df.limit(0), f, schema, line="no").count() == 0


def test_audits(spark):
    child = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, p int")
    parent = spark.createDataFrame([(5,)], "id int")
    assert [r.id for r in mapping.missing_parents(child, "p", parent, "id").collect()] == [2]
    twice = spark.createDataFrame([(1, None), (1, None), (1, 2), (1, 2)], "a int, b int")
    assert [tuple(r) for r in mapping.duplicates(twice, ["a", "b"]).collect()] == [(1, 2, 2)]
