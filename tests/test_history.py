import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from dimforge.operators import history

T0 = datetime(2024, 1, 1)
SCHEMA = "tenant int, uid long, start_at timestamp_ntz, seen timestamp_ntz, id long, state int, prefs string"
ARGS = {"keys": ["tenant", "uid"], "at": "start_at", "newest": ["seen", "id"], "attributes": ["state", "prefs"], "json": ["prefs"]}


def brute(rows):
    best = {}
    for r in rows:
        k = (r[0], r[1], r[2])
        if r[2] and (k not in best or (r[3], r[4]) > (best[k][3], best[k][4])):
            best[k] = r
    out, last, n = [], {}, {}
    for r in sorted(best.values(), key=lambda r: r[2]):
        k, v = (r[0], r[1]), (r[5], json.dumps(json.loads(r[6] or "{}"), sort_keys=True))
        if k not in last or last[k] != v:
            n[k] = n.get(k, 0) + 1
            out.append((*k, n[k], r[4], r[2]))
        last[k] = v
    return out


def test_random_observations(spark):
    rnd = random.Random(4)
    prefs = [None, "{}", '{"a": 1, "b": 2}', '{"b":2,"a":1}', '{"a": "1"}', '{\n "a": 1}', '{"é": 1}', '{"\\u00e9": 1}']
    rows = [(rnd.choice([1, 1, 1, 2]), rnd.choice([5, 5, 5, 6, 7]), T0 + timedelta(hours=6 * rnd.randrange(80)), T0 + timedelta(hours=rnd.randrange(9)), i, rnd.choice([None, 1, 1, 2]), rnd.choice(prefs)) for i in range(400)]
    df = spark.createDataFrame([*rows, *rows[:20], (1, 5, None, T0, 999, 1, None)], SCHEMA).withColumn("version", F.lit(99)).withColumn("end_at", F.lit(None))
    got = history.versions(df, **ARGS).collect()
    want = brute(rows)
    assert sorted((r.tenant, r.uid, r.version, r.id, r.valid_from) for r in got) == sorted(want)
    starts = {(t, u, v): s for t, u, v, _, s in want}
    assert all(r.valid_to == starts.get((r.tenant, r.uid, r.version + 1)) for r in got)
    assert history.versions(df.limit(0), **ARGS).count() == 0
    key = lambda r: (r.tenant, r.uid, r.version, r.id, r.valid_from, str(r.valid_to))
    for large in (0, 90):  # all, or some, of the entities cut into buckets
        assert sorted(map(key, history.versions(df, **ARGS, large=large).collect())) == sorted(map(key, got))
    plan = history.versions(df, **ARGS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join FullOuter" in plan


def test_null_keys_are_entities(spark):
    rows = [(None, 1, T0, T0, 1, 1, None), (None, 1, T0 + timedelta(days=1), T0, 2, 2, None), (1, None, T0, T0, 3, 1, "not json")]
    got = history.versions(spark.createDataFrame(rows, SCHEMA), **ARGS).collect()
    assert sorted((str(r.tenant), str(r.uid), r.version) for r in got) == [("1", "None", 1), ("None", "1", 1), ("None", "1", 2)]


def test_snapshots(spark):
    rows = [(1, "a", 1), (2, "a", 1), (1, "b", 2), (1, "b", 3), (3, None, 3), (2, "c", 4), (3, None, 4), (3, None, 4)]
    df = spark.createDataFrame([(k, v, T0 + timedelta(days=n)) for k, v, n in rows], "k int, v string, taken timestamp_ntz")
    got = sorted((r.k, str(r.v), r.valid_from.day - 1, r.valid_to.day - 1 if r.valid_to else None, r.deleted) for r in history.from_snapshots(df, keys=["k"], taken_at="taken", attributes=["v"]).collect())
    assert got == [(1, "a", 1, 2, False), (1, "b", 2, 4, True), (2, "a", 1, 2, True), (2, "c", 4, None, False), (3, "None", 3, None, False)]
    twice = df.unionByName(spark.createDataFrame([(1, "0", T0 + timedelta(days=3))], df.schema))
    assert history.from_snapshots(twice, keys=["k"], taken_at="taken", attributes=["v"]).count() == 5
    assert history.from_snapshots(df.limit(0), keys=["k"], taken_at="taken", attributes=["v"]).count() == 0


def test_events_between_snapshots(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, None), (2, 2, None), (None, 3, "z")], "k int, n int, v string")
    got = sorted((str(r.k), r.n, r.event) for r in history.diff_snapshots(df, ["k"], "n", ["v"], F.lit(3)).collect())
    assert got == [("1", 1, "inserted"), ("1", 2, "unchanged"), ("1", 3, "changed"), ("2", 1, "inserted"), ("2", 2, "unchanged"), ("2", 3, "deleted"), ("None", 3, "inserted")]


def test_map_attribute(spark):
    rows = [(1, 1, T0 + timedelta(days=i), T0, i, m) for i, m in enumerate([{"a": "1", "b": "2"}, {"b": "2", "a": "1"}, {"a": "1"}, None])]
    df = spark.createDataFrame(rows, "tenant int, uid long, start_at timestamp_ntz, seen timestamp_ntz, id long, m map<string,string>")
    got = history.versions(df, keys=["tenant", "uid"], at="start_at", newest=["seen", "id"], attributes=["m"])
    assert sorted((r.version, r.id) for r in got.collect()) == [(1, 0), (2, 2), (3, 3)]
