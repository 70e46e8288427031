import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dimforge.operators import dimensions as dim
from dimforge.operators import keys

T0 = datetime(2024, 1, 1)
L = "u int, s string, n int, m map<string,string>, start_at timestamp_ntz, delta int, source_uuid string"
ARGS = {"keys": ["u"], "attributes": ["s", "n", "m"]}


def snapshot_by_hand(rows, backwards=False):
    """Row by row, as the definition has it."""
    out = {}
    for u in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == u and r[4] is not None]
        own.sort(key=lambda r: r[6], reverse=backwards)
        own.sort(key=lambda r: r[5])
        own.sort(key=lambda r: r[4], reverse=backwards)
        group, tagged = 0, []
        for r in own:
            group += r[5] == 0
            tagged.append((group, r))
        for g, r in tagged:
            seen = [x for h, x in tagged if h == g and ((x[4], x[6]) >= (r[4], r[6]) if backwards else (x[4], x[6]) <= (r[4], r[6]))]
            seen.sort(key=lambda x: (x[4], x[6]), reverse=backwards)
            s = n = None
            m = {}
            for x in seen:
                s, n, m = x[1] if x[1] is not None else s, x[2] if x[2] is not None else n, {**m, **(x[3] or {})}
            k = (u, r[4])
            if k not in out or (r[6], -g) > out[k][0]:
                out[k] = ((r[6], -g), (s, n, m))
    return {k: v[1] for k, v in out.items()}


@pytest.mark.parametrize("backwards", [False, True])
def test_snapshot(spark, backwards):
    rnd = random.Random(7)
    rows = [
        (rnd.choice([1, 1, 1, 2, 3]), rnd.choice([None, "a", "b"]), rnd.choice([None, 1, 2]), rnd.choice([None, {"x": "1"}, {"y": "2"}, {"x": "3"}]), T0 + timedelta(hours=7 * rnd.randrange(40)), rnd.choice([0, 1, 1, 1]), f"{i:03d}")
        for i in range(150)
    ]
    df = spark.createDataFrame([*rows, (1, "z", 9, None, None, 0, "x")], L)
    for large in (10**6, 30, 0):  # no key, some, all keys spread over days
        got = dim.snapshot(df, **ARGS, backwards=backwards, large=large).collect()
        assert {(r.u, r.start_at): (r.s, r.n, r.m or {}) for r in got} == snapshot_by_hand(rows, backwards)
        assert len(got) == len(snapshot_by_hand(rows, backwards))
    assert dim.snapshot(df.limit(0), **ARGS).count() == 0
    assert dim.snapshot(df, **ARGS, required=["s", "n"]).where("s is null or n is null").count() == 0


def test_deduplicate_and_relabel(spark):
    at = lambda d, h, m=0: datetime(2024, 1, d, h, m)
    rows = [(1, "a", None, {"x": "1"}, at(1, 1, 5)), (1, "b", None, {"x": "1"}, at(1, 1, 50)), (1, "b", None, {"x": "1"}, at(1, 5)), (1, None, None, {"x": "1"}, at(20, 1)), (1, "b", None, {"x": "2"}, at(40 - 20, 3)), (2, "b", 1, None, at(3, 3))]
    df = spark.createDataFrame(rows, "u int, s string, n int, m map<string,string>, start_at timestamp_ntz")
    thin = dim.deduplicate(df, **ARGS, grain="hourly")
    assert sorted((r.u, str(r.s), r.start_at.day, r.start_at.hour) for r in thin.collect()) == [(1, "None", 20, 1), (1, "b", 1, 1), (1, "b", 20, 3), (2, "b", 3, 3)]
    filled = dim.deduplicate(df, **ARGS, grain="daily", defaults={"s": "b", "n": 0})
    assert sorted((r.u, r.start_at.day, r.n) for r in filled.collect()) == [(1, 1, 0), (1, 20, 0), (2, 3, 1)]
    got = sorted((r.u, r.version, r.start_at, r.end_at) for r in dim.relabel(thin, keys=["u"]).collect())
    assert got == [(1, 1, at(1, 1), at(20, 1)), (1, 2, at(20, 1), at(20, 3)), (1, 3, at(20, 3), None), (2, 1, at(3, 3), None)]
    assert dim.deduplicate(df.limit(0), **ARGS).count() == 0


def test_versions_across_months(spark):
    rows = [(1, T0 + timedelta(days=11 * i)) for i in range(30)] + [(1, T0)]
    got = sorted((r.version, r.start_at) for r in dim.relabel(spark.createDataFrame(rows, "u int, start_at timestamp_ntz"), keys=["u"]).collect())
    assert got[:3] == [(1, T0), (1, T0), (3, T0 + timedelta(days=11))] and got[-1][0] == 31


@pytest.mark.parametrize("more", [{}, {"required": ["s"], "defaults": {"n": 7}, "grain": "daily"}])
def test_consolidate_both_ways_of_large_keys(spark, more):
    rnd = random.Random(11)
    rows = [
        (rnd.choice([1, 1, 1, 2, None]), rnd.choice([None, "a", "b"]), rnd.choice([None, 1, 2]), rnd.choice([None, {"x": "1"}, {"y": "2"}]), T0 + timedelta(hours=9 * rnd.randrange(60)), rnd.choice([0, 1, 1, 1]), f"{i:03d}")
        for i in range(120)
    ]
    df = spark.createDataFrame(rows, L)
    flat = lambda got: sorted((str(r.u), str(r.s), str(r.n), str(sorted((r.m or {}).items())), str(r.start_at), r.version, str(r.end_at)) for r in got.collect())
    usual = flat(dim.consolidate(df, **ARGS, **more))
    ahead = {(str(u), str(t)): v for (u, t), v in snapshot_by_hand([r for r in rows if r[0] is not None]).items()}
    assert len(usual) > 20 and (more or all(str(ahead[k][0]) == s for u, s, _, _, t, _, _ in usual if (k := (u, t)) in ahead and ahead[k][0]))
    assert flat(dim.consolidate(df.where("u is not null"), **ARGS, **more, large=0)) == [r for r in usual if r[0] != "None"]
    old = spark.createDataFrame([(1, "z", 9, None, T0 - timedelta(days=40), 1, None)], "u int, s string, n int, m map<string,string>, start_at timestamp_ntz, version int, end_at timestamp_ntz")
    merged = flat(dim.consolidate(df.where("u is not null"), **ARGS, **more, target=old))
    assert len(merged) == len([r for r in usual if r[0] != "None"]) + 1 and sum(r[1] == "z" for r in merged) == 1
    assert dim.consolidate(df.limit(0), **ARGS).count() == 0


def test_upsert(spark):
    t = spark.createDataFrame([(1, "a", 1, "only"), (2, "b", 2, None), (None, "n", 3, None)], "k int, v string, w int, mine string")
    s = spark.createDataFrame([(1, None, 10, 0), (2, "B", 20, 0), (2, "A", 20, 0), (3, "c", 30, 0), (None, "new", 40, 0)], "k int, v string, w int, theirs int")
    got = sorted(map(tuple, dim.upsert(t, s, ["k"], ["v"]).collect()), key=str)
    assert got == sorted([(1, "a", 1, "only"), (2, "B", 2, None), (None, "n", 3, None), (3, "c", 30, None), (None, "new", 40, None)], key=str)
    assert dim.upsert(t, s.limit(0), ["k"]).count() == 3 and dim.upsert(t.limit(0), s, ["k"]).count() == 4
    twice = dim.upsert(dim.upsert(t, s.where("k is not null"), ["k"]), s.where("k is not null"), ["k"])
    assert twice.count() == 4


def test_insert_references_and_keys(spark):
    m = spark.createDataFrame([(5, "x", "old"), (7, "y", None)], "id long, name string, note string")
    src = spark.createDataFrame([("x",), ("z",), ("z",), (None,), ("w",)], "n string")
    once = dim.insert_references(m, src, {"name": "n"})
    rows = sorted((r.id, r.name) for r in once.collect())
    assert rows[:2] == [(5, "x"), (7, "y")] and {r[0] for r in rows[2:]} == {8, 9} and {r[1] for r in rows[2:]} == {"w", "z"}
    assert sorted((r.id, r.name) for r in dim.insert_references(once, src, {"name": "n"}).collect()) == rows
    assert dim.insert_references(m, src, {"name": "n"}, defaults={"name": "Unknown"}).where("name = 'Unknown'").count() == 1
    many = keys.assign(spark.range(5000).withColumnRenamed("id", "k").repartition(9), ["k"])
    got = [r.id for r in many.collect()]
    assert sorted(got) == list(range(1, 5001))
    assert {tuple(r) for r in many.collect()} == {tuple(r) for r in keys.assign(spark.range(5000).withColumnRenamed("id", "k"), ["k"]).collect()}


def test_stage_and_denormalize(spark):
    users = spark.createDataFrame([(1, 10, 1), (2, 10, 2), (3, 10, 1)], "id long, tenant int, user int")
    src = spark.createDataFrame([(10, 1, "a"), (10, 2, "b"), (10, 9, "c"), (None, 1, "d")], "t int, u int, v string")
    got = sorted((str(r.user_id), r.v) for r in dim.stage(src, [dim.Lookup("user_id", users, {"tenant": "t", "user": "u"})], ["v"]).collect())
    assert got == [("1", "a"), ("2", "b"), ("None", "c"), ("None", "d")]
    facts = spark.createDataFrame([(1, 2, 5), (2, None, 6), (9, 1, 7)], "user_id long, manager_id long, total int").withColumn("last_modified_at", F.lit(1))
    joins = [dim.Join("user_id", users, {"user": "user"}), dim.Join("manager_id", users, {"manager_user": "user"})]
    out = dim.denormalize(facts, joins, ["total", "last_modified_at"])
    assert out.columns == ["user", "manager_user", "total"]
    assert [tuple(r) for r in out.collect()] == [(None, 1, 7), (1, 2, 5), (2, None, 6)]
