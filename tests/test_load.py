from datetime import datetime

import pytest

from dimforge.operators import load
from dimforge.schema.model import Catalog, Column, Reference, Row

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def model():
    c = Catalog(w="postgres")
    state = c.w.dimension("user_account_state", "mini", [Column("name", "string", unique=("name",)), Column("description", "string", null=True)], rows=[Row({"name": "active"}, default=True)])
    dept = c.w.dimension("department", "mini", [Column("tenant_id", natural_key=True), Column("department_id", natural_key=True)])
    user = c.w.dimension("user", "four", [Column("tenant_id", natural_key=True), Column("user_id", natural_key=True), Column("name", "string", null=True), Column("preferences", "key_value", null=True)], [Reference(dept, insert=True), Reference(state), Reference(state, label="hr", null=True)])
    return c, state, dept, user


def test_dimension(spark, model):
    c, state, dept, user = model
    states = spark.createDataFrame([(1, "active", None), (2, "inactive", None)], "id long, name string, description string")
    depts = spark.createDataFrame([(4, 10, 1)], "id long, tenant_id int, department_id int")
    rows = spark.createDataFrame(
        [(10, 100, 1, "active", None, "Ann", '{"a": "1"}', T0, "file", "u1", 0), (10, 101, 2, "inactive", "active", None, None, T0, "file", "u2", 1), (10, 102, None, "gone", None, "Bob", "{}", T0, "file", "u3", 0)],
        "tenant_id int, user_id int, `department.department_id` int, `user_account_state.name` string, `hr_user_account_state.name` string, name string, preferences string, start_at timestamp_ntz, source_kind string, source_uuid string, delta int",
    )
    members = {"user_account_state_type": states, "department_type": depts}
    kinds = "id long, department_type_id long, user_account_state_type_id long, hr_user_account_state_type_id long, tenant_id int, user_id int, name string, preferences map<string,string>, start_at timestamp_ntz, source_kind string, source_uuid string, delta int"
    empty = spark.createDataFrame([], kinds)
    ledger, after = load.load_dimension(rows, user, members, empty)
    assert sorted((r.id, r.tenant_id, r.department_id) for r in after["department_type"].collect()) == [(4, 10, 1), (5, 10, 2)]
    got = {r.user_id: r for r in ledger.collect()}
    assert {r.id for r in got.values()} == {1, 2, 3}
    assert (got[100].department_type_id, got[100].user_account_state_type_id, got[100].preferences) == (4, 1, {"a": "1"})
    assert (got[101].department_type_id, got[101].user_account_state_type_id, got[101].hr_user_account_state_type_id) == (5, 2, 1)
    assert (got[102].department_type_id, got[102].user_account_state_type_id) == (None, None)
    again, _ = load.load_dimension(rows, user, after, ledger)
    assert sorted((r.id, r.user_id) for r in again.collect()) == sorted((r.id, r.user_id) for r in got.values())


def test_fact_rollup_denormalize(spark):
    c = Catalog(w="postgres")
    date = c.w.dimension("date", "date", [Column("date_id", natural_key=True)])
    agent = c.w.dimension("user_agent", "mini", [Column("name", "string", unique=("shared",)), Column("version", "string", default="Unknown", unique=("shared",))])
    tenant = c.w.dimension("tenant", "two", [Column("tenant_id", natural_key=True)])
    user = c.w.dimension("user", "two", [Column("tenant_id", natural_key=True), Column("user_id", natural_key=True)])
    group = c.w.dimension("group", "two", [Column("group_id", natural_key=True)], rows=[Row({"group_id": -1}, default=True)])
    session = c.w.dimension("session", "mini", [Column("id", surrogate_key=True)])
    refs = [Reference(date), Reference(tenant, through=("user",)), Reference(user), Reference(group, default=True, unknown=-2), Reference(agent, insert=True), Reference(session, degenerate=True)]
    hourly, daily = c.w.fact("visits", [Column("total", measure=True, aggregate="sum")], refs, grains=("hourly", "daily"), partition="y%Ym%m")
    version = "start_at timestamp_ntz, end_at timestamp_ntz, version int"
    members = {
        "date_dimension": spark.createDataFrame([(20240105, 20240105), (20240106, 20240106)], "id int, date_id int"), "user_agent_type": spark.createDataFrame([], "id long, name string, version string"),
        "tenant_dimension": spark.createDataFrame([(1, 10, T0, None, 1)], f"id long, tenant_id int, {version}"), "user_dimension": spark.createDataFrame([(7, 10, 100, T0, None, 1)], f"id long, tenant_id int, user_id int, {version}"),
        "group_dimension": spark.createDataFrame([(3, -1, T0, None, 1), (4, 5, T0, None, 1)], f"id long, group_id int, {version}"),
    }
    sec = 1704412800  # 2024-01-05
    rows = spark.createDataFrame(
        [(20240105, None, 10, 100, 5, "x", None, "s1", sec + 60, 2), (20240105, 10, 10, 100, None, "x", "Unknown", "s1", sec + 120, 3), (20240106, 10, 10, 100, 99, "y", "2", "s2", sec + 90000, 4), (20240105, 10, 10, 999, 5, "x", None, "s3", sec, 9)],
        "`date.date_id` int, `tenant.tenant_id` int, `user.tenant_id` int, `user.user_id` int, `group.group_id` int, `user_agent.name` string, `user_agent.version` string, `session.id` string, time_key long, total int",
    )
    staged, after = load.load_fact(rows, hourly, members)
    got = sorted((r.date_dimension_id, r.tenant_dimension_id, r.user_dimension_id, r.group_dimension_id, r.session_type_id, r.total, r.period) for r in staged.collect())
    assert got == [(20240105, 1, 7, 3, "s1", 3, "y2024m01"), (20240105, 1, 7, 4, "s1", 2, "y2024m01"), (20240106, 1, 7, -2, "s2", 4, "y2024m01")]
    assert sorted((r.name, r.version) for r in after["user_agent_type"].collect()) == [("x", "Unknown"), ("y", "2")]
    by_day = load.rollup(staged, hourly, daily, date="date", members=members["date_dimension"])
    assert sorted((r.date_dimension_id, r.group_dimension_id, r.total, r.time_key) for r in by_day.collect()) == [(20240105, 3, 3, sec), (20240105, 4, 2, sec), (20240106, -2, 4, sec + 86400)]
    flat = load.denormalize(staged, hourly, after, exclude=("time_key",))
    assert flat.columns[:2] == ["date_dimension_date_id", "tenant_dimension_tenant_id"] and "user_agent_type_version" in flat.columns
    assert flat.count() == 3
