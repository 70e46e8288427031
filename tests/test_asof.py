import random
from datetime import datetime, timedelta

from dimforge.operators.asof import change_histories, known_at
from tests.brute import micros, read_time

T0 = datetime(2024, 1, 1)
H = "uid long, start_at timestamp_ntz, seen timestamp_ntz, id long, state int, prefs string"
ARGS = {"entity": "u", "time": "t", "history_entity": "uid", "valid_from": "start_at", "known_from": "seen", "tie": "id"}


def brute(u, t, hist):
    own = [h for h in hist if h[0] == u and u is not None and t is not None and h[1] and h[2] and h[1] <= t and h[2] <= t]
    return max(own, key=lambda h: (h[1], h[2], h[3]), default=None)


def test_random(spark):
    rnd = random.Random(2)
    hist = [(rnd.choice([1, 1, 1, 2, 3, None]), T0 + timedelta(hours=rnd.randrange(200)), T0 + timedelta(hours=rnd.randrange(300)), i, rnd.choice([None, 1, 2]), rnd.choice([None, "{}"])) for i in range(150)]
    hist += [(2, None, T0, 900, 1, None), (2, T0, None, 901, 1, None)]
    events = [(i, rnd.choice([1, 1, 2, 3, 4, None]), None if i % 31 == 0 else T0 + timedelta(hours=rnd.randrange(400)), i) for i in range(400)]
    e = spark.createDataFrame(events + events[:5], "n int, u long, t timestamp_ntz, id int")
    h = spark.createDataFrame(hist, H)
    for large in (10**6, 40, 0):  # no entity, the larger ones, all of them spread over buckets and salts
        got = known_at(e, h, **ARGS, attributes=["id", "state", "prefs"], large=large, salts=3).collect()
        assert len(got) == 405
        for r in got:
            want = brute(r.u, r.t, hist)
            assert (r.known_id, r.known_state, r.known_prefs) == ((want[3], want[4], want[5]) if want else (None, None, None)), (large, r)


def test_histories_hold_changes_only(spark):
    rows = [(1, T0, T0, 1, 5, "a"), (1, T0 + timedelta(days=1), T0, 2, 5, "b"), (1, T0 + timedelta(days=2), T0, 3, 6, "b"), (1, T0 + timedelta(hours=1), T0 + timedelta(days=3), 4, 9, "late")]
    got = change_histories(spark.createDataFrame(rows, H), entity="uid", valid_from="start_at", known_from="seen", tie="id", attributes=["state", "prefs"])
    said = [(r.c0.value if r.c0 else "-", r.c1.value if r.c1 else "-") for r in got.orderBy("at").collect()]
    assert said == [(5, "a"), ("-", "b"), (6, "-")]  # the late row was never the newest known


def test_changes_at_the_first_moment_of_a_bucket(spark):
    rows = [(1, T0 + timedelta(days=i), T0, i, i, None) for i in range(6)]
    e = spark.createDataFrame([(1, T0 + timedelta(days=i, hours=h)) for i in range(8) for h in (0, 5)], "u long, t timestamp_ntz")
    got = known_at(e, spark.createDataFrame(rows, H), **ARGS, attributes=["state"], large=0, salts=2).collect()
    assert len(got) == 16 and all(r.known_state == min((r.t - T0).days, 5) for r in got)


def test_empty_sides_and_clashing_names(spark):
    e = spark.createDataFrame([(1, T0, "x")], "u long, t timestamp_ntz, event string")
    none = known_at(e, spark.createDataFrame([], H), **ARGS, attributes=["state"]).collect()
    assert len(none) == 1 and none[0].event == "x" and none[0].known_state is None
    assert known_at(e.limit(0), spark.createDataFrame([(1, T0, T0, 1, 5, None)], H), **ARGS, attributes=["state"]).count() == 0
    clash = e.withColumnsRenamed({"event": "e"}).selectExpr("u", "t", "e", "1 as at", "2 as b", "3 as c0")
    row = known_at(clash, spark.createDataFrame([(1, T0, T0, 1, 5, None)], H), **ARGS, attributes=["state"]).first()
    assert (row.at, row.b, row.c0, row.known_state) == (1, 2, 3, 5)


def test_table(spark, data):
    from dimforge.queries.problems import p2_found

    users = {}
    for r in spark.read.parquet(f"{data}/user_dimension.parquet").collect():
        users.setdefault(r.user_id, []).append((micros(r.start_at), micros(r.last_modified_at), r.id))
    zones = {r.tenant_id: r.time_zone for r in spark.read.parquet(f"{data}/tenant_dimension.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{data}/visits_file_fact_stage.parquet").collect():
        _, t = read_time(r.time_key, zones.get(r.tenant_dimension_tenant_id))
        own = [h for h in users.get(r.user_dimension_user_id, []) if t is not None and h[0] <= t and h[1] <= t]
        if own:
            want.add((r.line_id, max(own)[2]))
    assert {tuple(r) for r in p2_found(spark, data).collect()} == want


def test_map_attribute(spark):
    e = spark.createDataFrame([(1, T0 + timedelta(days=3)), (2, T0)], "u long, t timestamp_ntz")
    h = spark.createDataFrame([(1, T0, T0, 1, {"a": "1"}), (1, T0 + timedelta(days=1), T0, 2, {"a": "2"})], "uid long, start_at timestamp_ntz, seen timestamp_ntz, id long, prefs map<string,string>")
    assert {r.u: r.known_prefs for r in known_at(e, h, **ARGS, attributes=["prefs"]).collect()} == {1: {"a": "2"}, 2: None}
