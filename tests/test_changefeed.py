import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from dimforge.operators import changefeed as cf

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, tenant int, state string, tier string, kind string, uuid string, start_at timestamp_ntz, seen timestamp_ntz, delta int"
KEY, ORDER = ["tenant"], ["start_at", "delta", "uuid", "kind"]


def replayed(df):
    changes = cf.assemble(df, ["tenant", "kind", "uuid", "start_at"], ["seen", "id"])
    return cf.replay(changes, key=KEY, order=ORDER, op="delta", attributes=["state", "tier"], origin=["kind", "uuid"])


def brute(rows):
    best = {}
    for r in rows:
        k = (r[1], r[4], r[5], r[6])
        if k not in best or (r[7], r[0]) > (best[k][7], best[k][0]):
            best[k] = r
    state = {}
    for r in sorted(best.values(), key=lambda r: (r[6], r[8], r[5], r[4])):
        _, t, s, p, kind, uuid, _, _, d = r
        if d == -1:
            state.pop(t, None)
        elif d == 0:
            state[t] = {"state": (s, kind, uuid) if s else None, "tier": (p, kind, uuid) if p else None}
        elif t in state:
            for n, v in (("state", s), ("tier", p)):
                if v is not None:
                    state[t][n] = (v, kind, uuid)
    return state


def test_random_feeds(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        t = 1 if rnd.random() < 0.4 else rnd.randrange(2, 9)
        rows.append((i, t, rnd.choice([None, "a", "b"]), rnd.choice([None, "x"]), rnd.choice("jk"), f"u{rnd.randrange(40)}", T0 + timedelta(hours=rnd.randrange(30)), T0 + timedelta(hours=rnd.randrange(9)), rnd.choice([0, 1, 1, 1, -1])))
    df = spark.createDataFrame(rows + rows[:50], SCHEMA).repartition(5)
    got = {r.tenant: {a: tuple(r[a]) if r[a] else None for a in ("state", "tier")} for r in replayed(df).collect()}
    assert got == brute(rows)
    long = cf.setters(replayed(df), KEY, ["state", "tier"], ["kind", "uuid"])
    assert long.columns == ["tenant", "attribute", "kind", "uuid"]
    assert long.count() == sum(v is not None for s in got.values() for v in s.values())


def test_empty_and_unplaceable(spark):
    assert replayed(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, "a", None, "j", "u", T0, T0, 0), (2, 1, "a", None, "j", "u", None, T0, 0), (3, 2, "a", None, "j", "u", T0, T0, None), (4, 3, "a", None, "j", "u", T0, T0, 7), (5, 4, None, "x", None, None, T0, T0, 0)]
    got = {r.tenant: (r.state, r.tier) for r in replayed(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {4} and got[4][0] is None and got[4][1].value == "x"


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "complete!", T0, 0, "k")], "tenant int, complete string, start_at timestamp_ntz, delta int, `key0` string")
    got = cf.replay(df, key=["tenant"], order=["start_at"], op="delta", attributes=["complete", "key0"])
    assert got.first().complete.value == "complete!" and got.first().key0.value == "k"


def test_uuid_notations(spark):
    same = ["985f7951-4957-4418-a1f4-954b4579147c", "{985F7951-4957-4418-A1F4-954B4579147C}", "985f795149574418a1f4954b4579147c", " 985F795149574418A1F4954B4579147C "]
    got = {r[0] for r in spark.createDataFrame([(s,) for s in same], "u string").select(cf.canonical_uuid(F.col("u"))).collect()}
    assert got == {same[0]}
    assert spark.createDataFrame([(" Not One ",), (None,)], "u string").select(cf.canonical_uuid(F.col("u")).alias("u")).orderBy("u").collect()[1].u == "not one"


def test_watermark(spark):
    mark = lambda rows, **k: cf.watermark(spark.createDataFrame(rows, "n long, size int"), "n", **k).first()[0]
    assert mark([(1, 1), (2, 2), (2, 2), (3, 1), (5, 1)], size="size") == 3
    assert mark([(1, 1), (2, 2), (3, 1)], size="size") == 1  # one of two changes of transaction 2 isn't here yet
    assert mark([(2, 1), (3, 1)], size="size") == 0
    assert mark([], size="size") == 0
    assert mark([(7, 1), (8, 1)], first=7) == 8
    held = cf.committed(spark.createDataFrame([(1, 1), (2, 1), (4, 1), (None, 1)], "n long, size int"), "n", "size")
    assert sorted(r.n for r in held.collect()) == [1, 2]


def test_maps_are_carried(spark):
    df = spark.createDataFrame([(1, T0, 1, {"a": "old"}), (1, T0, 2, {"a": "new"}), (2, T0, 1, None)], "t int, start_at timestamp_ntz, seen int, m map<string,string>")
    got = {r.t: r.m for r in cf.assemble(df, ["t", "start_at"], ["seen"]).collect()}
    assert got == {1: {"a": "new"}, 2: None}


def test_numbered_feeds(spark):
    """Numbers, watermark and replay of a whole feed against the plain replay of all of it, and of its part before a gap."""
    rnd = random.Random(9)
    rows = [(i, rnd.randrange(4), rnd.choice([None, "a", "b"]), None, "k", rnd.choice([None, "u", "v", "w"]), T0 + timedelta(hours=rnd.randrange(50), minutes=rnd.randrange(3)), T0, rnd.choice([0, 1, 1, -1])) for i in range(300)]
    changes = cf.assemble(spark.createDataFrame([*rows, (999, 1, "a", None, "k", "u", None, T0, 0)], SCHEMA), ["tenant", "kind", "uuid", "start_at"], ["seen", "id"])
    numbered = cf.sequence(changes, ORDER)
    got = numbered.collect()
    assert {r.commit for r in got if r.start_at is None} == {None}
    low = lambda v: (v is not None, v or "")
    keys = sorted({(r.start_at, r.delta, low(r.uuid), r.kind) for r in got if r.start_at})
    assert all(keys[r.commit - 1] == (r.start_at, r.delta, low(r.uuid), r.kind) for r in got if r.start_at)
    assert cf.watermark(numbered, "commit").first()[0] == len(keys)
    replay = lambda df: {r.tenant: r.state.value if r.state else None for r in cf.replay(df, key=KEY, order=["commit"], op="delta", attributes=["state"]).collect()}
    cut = numbered.where("commit <> 40")
    assert replay(cf.committed(cut, "commit")) == replay(numbered.where("commit < 40")) != replay(cut)
    assert cf.sequence(changes.limit(0), ORDER).count() == 0


def test_sequence_keeps_clashing_names(spark):
    df = spark.createDataFrame([(T0, 1, 2), (T0, 1, 3)], "start_at timestamp_ntz, __bucket int, __local int")
    assert sorted((r["__local"], r.commit) for r in cf.sequence(df, ["start_at", "__bucket"]).collect()) == [(2, 1), (3, 1)]
