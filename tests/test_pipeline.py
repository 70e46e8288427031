"""Loads of all stage rows, held against plain Python."""

from collections import Counter, defaultdict
from datetime import timedelta

from dimforge.queries import pipeline, problems
from tests.brute import EPOCH, read_time


def valid(at, versions):
    """Keys of the versions that hold at `at`, ends included, or the first one before it; -2 for none."""
    return [i for i, start, end, n in versions if (at >= start and (end is None or at <= end)) or (at < start and n == 1)] or [-2]


def test_all_rows_are_loaded_or_rejected(spark, data):
    read = lambda t: spark.read.parquet(f"{data}/{t}.parquet").collect()
    tenants, users, zone, features, names = defaultdict(list), defaultdict(list), {}, {}, {}
    for r in read("tenant_dimension"):
        tenants[r.tenant_id].append((r.id, r.start_at, r.end_at, r.version))
        zone[r.tenant_id] = max(filter(None, (zone.get(r.tenant_id), r.time_zone)), default=None)
        names[r.id] = r.tenant_id
    for r in problems._versions(spark, data, "id").collect():
        users[r.tenant_id, r.user_id].append((r.id, r.valid_from, r.valid_to, r.version))
    for r in read("feature_type"):
        features[r.name] = r.id

    facts, flat, rolled, rejected, notations = Counter(), Counter(), Counter(), {}, Counter()
    for r in read("visits_file_fact_stage"):
        readable, us = read_time(r.time_key, zone.get(r.tenant_dimension_tenant_id))
        if us is None:
            rejected[r.line_id] = "no single instant" if readable else "unreadable"
            continue
        s = us // 10**6
        at = EPOCH + timedelta(seconds=s)
        notations[r.time_key.strip().isdigit() and len(r.time_key) == 10] += 1
        f = features.get(r.feature_type_name, -2)
        for t in valid(at, tenants[r.tenant_dimension_tenant_id]):
            for u in valid(at, users[r.tenant_dimension_tenant_id, r.user_dimension_user_id]):
                facts[t, u, f, r.line_id, r.total, s, f"y{at:%Y}m{at:%m}"] += 1
                rolled[int(f"{at:%Y%m%d}"), t, f, s - s % 86400] += r.total or 0
                flat[names.get(t), r.feature_type_name if f != -2 else None, r.line_id, r.total] += 1
    assert notations[False] > 100 and len(set(rejected.values())) == 2

    keys = ("tenant_dimension_id", "user_dimension_id", "feature_type_id", "line_id", "total", "time_key", "period")
    assert Counter(tuple(r[k] for k in keys) for r in pipeline.load_fact_visits(spark, data).collect()) == facts
    assert {r.line_id: r.reason for r in pipeline.load_rejects(spark, data).collect()} == rejected
    got = {(r.date_id, r.tenant_dimension_id, r.feature_type_id, r.time_key): r.total or 0 for r in pipeline.load_and_roll_up(spark, data).collect()}
    assert got == dict(rolled)
    named = {i: n for n, i in features.items()}
    want = Counter({(t, n, line, total): c for (t, n, line, total), c in flat.items()})
    if -2 in named:  # the seed row of unknown members has a name
        want = Counter()
        for (t, n, line, total), c in flat.items():
            want[t, named[-2] if n is None else n, line, total] += c
    assert Counter((r.tenant_dimension_tenant_id, r.feature_type_name, r.line_id, r.total) for r in pipeline.load_and_denormalize(spark, data).collect()) == want


def test_all_periods_are_kept_when_one_is_replaced(spark, data):
    """All orders are written and read back."""
    want = spark.read.parquet(f"{data}/orders.parquet").selectExpr("count(*)", "count(distinct date_trunc('month', o_orderdate))", "count_if(year(o_orderdate) = 1996 and month(o_orderdate) = 2)").first()
    got = pipeline.replace_one_period(spark, data).selectExpr("count(*)", "count(distinct period)", "count_if(o_custkey < 0)").first()
    assert tuple(got) == tuple(want) and got[1] > 12
