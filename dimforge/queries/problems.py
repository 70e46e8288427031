"""Queries of the data problems over the warehouse tables, and SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimforge import runtime, session
from dimforge.operators import asof, changefeed, history, incremental, orphans, rejects, timestamps
from dimforge.operators.rejects import Field
from dimforge.queries import oracle
from dimforge.sources import fs

USER_FIELDS = (Field("id", "whole", True), Field("tenant_id", "whole", True), Field("admin", "boolean"), Field("preferences", "mapping"), Field("deleted_at", "time"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def zones(spark: SparkSession, sf: str) -> DataFrame:
    """tenant_id, zone: one row per tenant."""
    return table(spark, sf, "tenant_dimension").groupBy("tenant_id").agg(F.max("time_zone").alias("zone"))


# 1 ------------------------------------------------------------------ inserts, updates and deletes

ATTRIBUTES = ["tenant_account_state", "tenant_premium_state"]


ORDER = ["start_at", "delta", "source_uuid", "source_kind"]


def commit_log(spark: SparkSession, sf: str, attributes: list[str]) -> DataFrame:
    """The changes of the feed with the number of the transaction each belongs to, written once: its watermark and its replay both read it."""
    feed = table(spark, sf, "tenant_ledger").select("id", "tenant_id", *attributes, "source_kind", changefeed.canonical_uuid(F.col("source_uuid")).alias("source_uuid"), "start_at", "last_modified_at", "delta")
    # One exchange by the hour serves both: the hour is part of what tells changes apart, and numbers are counted within it.
    dealt = feed.withColumn("hour", F.date_trunc("hour", "start_at")).repartition("hour")
    changes = changefeed.assemble(dealt, ["hour", "tenant_id", "source_kind", "source_uuid", "start_at"], ["last_modified_at", "id"]).drop("id", "last_modified_at")
    return changefeed.sequence(changes, ORDER, bucketed="hour").drop("hour")


def replayed(changes: DataFrame, attributes: list[str]) -> DataFrame:
    return changefeed.replay(changes, key=["tenant_id"], order=["commit"], op="delta", attributes=attributes, origin=["source_kind", "source_uuid"])


def tenant_state(spark: SparkSession, sf: str, attributes: list[str]) -> DataFrame:
    """The state at the watermark. The feed says nothing of the size of a transaction, so each is complete as it came."""
    return replayed(changefeed.committed(commit_log(spark, sf, attributes), "commit"), attributes)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return changefeed.setters(tenant_state(spark, sf, ATTRIBUTES), ["tenant_id"], ATTRIBUTES, ["source_kind", "source_uuid"])


def p1_state(spark: SparkSession, sf: str) -> DataFrame:
    """The current record of every tenant."""
    names = [*ATTRIBUTES, "preferences"]
    return tenant_state(spark, sf, names).select("tenant_id", *[F.col(a)["value"].alias(a) for a in names])


def p1_held(spark: SparkSession, sf: str) -> DataFrame:
    """The current records while a transaction two thirds on lacks a change and one three quarters on hasn't come: what follows is held."""
    log = commit_log(spark, sf, ATTRIBUTES)
    sized = log.groupBy("commit").agg(F.count(F.lit(1)).alias("n"))
    last = log.agg(F.max("commit")).scalar()
    short, absent = F.floor(last * 2 / 3), F.floor(last * 3 / 4)
    announced = sized.select(F.col("commit").alias("c"), F.when(F.col("commit") == short, F.col("n") + 1).otherwise(F.col("n")).alias("size"))
    feed = log.join(announced, F.col("commit") == F.col("c")).where(F.col("commit") != absent).drop("c")
    state = replayed(changefeed.committed(feed, "commit", "size"), ATTRIBUTES)
    return state.select("tenant_id", *[F.col(a)["value"].alias(a) for a in ATTRIBUTES], changefeed.watermark(feed, "commit", "size").scalar().alias("watermark"))


_P1 = """
with u as (
  select *, lower(regexp_replace(trim(source_uuid), '[{}()\\s-]', '', 'g')) as bare from tenant_ledger
), c as (
  select id, tenant_id, tenant_account_state, tenant_premium_state, preferences, source_kind, start_at, last_modified_at, delta,
    substr(bare, 1, 8) || '-' || substr(bare, 9, 4) || '-' || substr(bare, 13, 4) || '-' || substr(bare, 17, 4) || '-' || substr(bare, 21, 12) as source_uuid
  from u
), d as (
  select * from c qualify row_number() over (partition by tenant_id, source_kind, source_uuid, start_at order by last_modified_at desc, id desc) = 1
), n as (
  select *, row_number() over (partition by tenant_id order by start_at, delta, source_uuid, source_kind) as rn from d
), e as (
  select tenant_id, max(rn) filter (where delta = 0) as complete, max(rn) filter (where delta = -1) as removal from n group by tenant_id
), live as (
  select n.*, e.complete from n join e on n.tenant_id = e.tenant_id
  where e.complete is not null and (e.removal is null or e.removal < e.complete) and n.rn >= e.complete and n.delta in (0, 1)
)
"""
P1_FOUND = _P1 + """
select tenant_id, 'tenant_account_state' as attribute, source_kind, source_uuid from live where tenant_account_state is not null
  qualify row_number() over (partition by tenant_id order by rn desc) = 1
union all
select tenant_id, 'tenant_premium_state', source_kind, source_uuid from live where tenant_premium_state is not null
  qualify row_number() over (partition by tenant_id order by rn desc) = 1
"""
P1_STATE = _P1 + """
select tenant_id, arg_max(tenant_account_state, rn) filter (where tenant_account_state is not null) as tenant_account_state,
  arg_max(tenant_premium_state, rn) filter (where tenant_premium_state is not null) as tenant_premium_state,
  arg_max(preferences, rn) filter (where preferences is not null) as preferences
from live group by tenant_id
"""
P1_HELD = _P1.split(", n as (")[0] + """, q as (
  select *, dense_rank() over (order by start_at, delta, source_uuid, source_kind) as n from d where start_at is not null
), m as (
  select n, count(*) + (n = (select max(n) * 2 // 3 from q))::int as size, count(*) as got from q group by n
), mark as (
  select min(n) - 1 as w from m where got < size or n = (select max(n) * 3 // 4 from q)
), done as (
  select * from q where n <= (select w from mark)
), e as (
  select tenant_id, max(n) filter (where delta = 0) as complete, max(n) filter (where delta = -1) as removal from done group by tenant_id
), live as (
  select c.* from done c join e on c.tenant_id = e.tenant_id where e.complete is not null and (e.removal is null or e.removal < e.complete) and c.n >= e.complete and c.delta in (0, 1)
)
select tenant_id, arg_max(tenant_account_state, n) filter (where tenant_account_state is not null) as tenant_account_state,
  arg_max(tenant_premium_state, n) filter (where tenant_premium_state is not null) as tenant_premium_state, (select w from mark) as watermark from live group by tenant_id
"""


# 2, 6 -------------------------------------------------------------------- instants, known attributes


def stage_instants(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Stage rows with the instant of their time_key; `plain` for bare epoch seconds."""
    stage = table(spark, sf, "visits_file_fact_stage").select("line_id", "time_key", "tenant_dimension_tenant_id", *columns)
    z = zones(spark, sf).withColumnRenamed("tenant_id", "tenant_dimension_tenant_id")
    joined = stage.join(z, "tenant_dimension_tenant_id", "left")
    return timestamps.normalise(joined, "time_key", "zone", plain="plain").drop("zone", "time_key")


def _known(spark: SparkSession, sf: str, attributes: list[str]) -> DataFrame:
    events = stage_instants(spark, sf, "user_dimension_user_id").where("epoch_us is not null").select("line_id", "user_dimension_user_id", "epoch_us")
    users = table(spark, sf, "user_dimension").select("user_id", "start_at", "last_modified_at", F.col("id").alias("row_id"), F.col("id").alias("user_dimension_id"), *[a for a in attributes if a != "user_dimension_id"])
    return asof.known_at(events, users, entity="user_dimension_user_id", time="epoch_us", history_entity="user_id", valid_from="start_at", known_from="last_modified_at", tie="row_id", attributes=attributes, prefix="known_", crowd=table(spark, sf, "visits_file_fact_stage"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    known = _known(spark, sf, ["user_dimension_id"])
    return known.where("known_user_dimension_id is not null").select("line_id", F.col("known_user_dimension_id").alias("user_dimension_id"))


def p2_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Every timed stage row with each attribute of its user as known then."""
    return _known(spark, sf, ["user_dimension_id", "user_account_state_type_id", "hr_user_account_state_type_id", "preferences"])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    users = rejects.accepted(rejects.parse(table(spark, sf, "user_file"), "raw_line", USER_FIELDS, keep=["line_id"], line_no="line_no", wanted=()))
    z = zones(spark, sf).select(F.col("tenant_id").cast("string").alias("tenant_id"), "zone")
    deleted = timestamps.normalise(users.select("line_id", "tenant_id", "deleted_at").join(z, "tenant_id", "left"), "deleted_at", "zone", plain="plain")
    pick = lambda df, name: df.where("epoch_us is not null and not plain").select(F.lit(name).alias("source_name"), F.col("line_id").alias("row_id"), "epoch_us")
    return pick(deleted, "user_file").unionByName(pick(stage_instants(spark, sf), "visits_file_fact_stage"))


_KNOWN = "with " + oracle.times(oracle.STAGE) + """, e as (
  select line_id, user_dimension_user_id, epoch_us from visits_file_fact_stage join instants on row_id = line_id where epoch_us is not null
), k as (
  select e.line_id, u.* from e join user_dimension u on u.user_id = e.user_dimension_user_id and epoch_us(u.start_at) <= epoch_us and epoch_us(u.last_modified_at) <= epoch_us
  qualify row_number() over (partition by e.line_id order by u.start_at desc, u.last_modified_at desc, u.id desc) = 1
)
"""
P2_FOUND = _KNOWN + "select line_id, id as user_dimension_id from k"
P2_ATTRIBUTES = _KNOWN + """
select e.*, k.id as known_user_dimension_id, k.user_account_state_type_id as known_user_account_state_type_id, k.hr_user_account_state_type_id as known_hr_user_account_state_type_id, k.preferences as known_preferences
from e left join k on k.line_id = e.line_id
"""
P6_FOUND = "with " + oracle.RECORDS + ", " + oracle.times(f"(from {oracle.DELETED} union all from {oracle.STAGE})") + "select src as source_name, row_id, epoch_us from instants where epoch_us is not null and not plain"


# 3 ----------------------------------------------------------------------------- new or changed rows


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    log, state = table(spark, sf, "load_run"), f"{session.work_dir(spark)}/manifest-{uuid.uuid4().hex}"
    pending = lambda t: incremental.pending_rows(table(spark, sf, t), t, "id", "last_modified_at", log, incremental.Manifest(spark, f"{state}/{t}"))
    # The tables have nothing to do with each other: their listings are made side by side.
    parts = runtime.in_parallel(pending, [{"t": t} for t in ("user_dimension", "visits_fact")], 2)
    return parts[0].unionByName(parts[1])


def p3_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """What two runs over files make of `visits_fact`: between them most files grow and new ones come."""
    where = f"{session.work_dir(spark)}/loads-{uuid.uuid4().hex}"
    facts = table(spark, sf, "visits_fact").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(16)))
    manifest = incremental.Manifest(spark, f"{where}/manifest")
    for n, rows in enumerate((facts.where("part < 12 and id % 3 > 0"), facts)):
        rows.repartition("part").write.partitionBy("part").parquet(f"{where}/written-{n}")
        for p in fs.glob(spark, f"{where}/written-{n}/part=*/*.parquet"):
            place = f"{where}/in/{p.rsplit('part=', 1)[1].split('/')[0]}.parquet"
            fs.remove(spark, place)
            fs.mkdir(spark, f"{where}/in")
            fs.rename(spark, p, place)
        read = lambda paths: spark.read.schema(facts.drop("part").schema).parquet(*paths)
        incremental.run(read, [f"{where}/in"], manifest, f"{where}/out", lambda df: df.select("id", "total", F.col("_metadata.file_path").alias("input_id")))
    return incremental.result(manifest, f"{where}/out").select("id", "total")


P3_LOADED = "select id, total from visits_fact"
P3_FOUND = """
with ok as (
  select table_name, window_start, window_end from (
    select *, row_number() over (partition by run_id order by logged_at desc, lower(trim(status)) desc) as rn from load_run
  ) where rn = 1 and lower(trim(status)) = 'succeeded'
)
select 'user_dimension' as table_name, id as row_id from user_dimension u
where not exists (select 1 from ok where table_name = 'user_dimension' and u.last_modified_at >= window_start and u.last_modified_at < window_end)
union all
select 'visits_fact', id from visits_fact v
where not exists (select 1 from ok where table_name = 'visits_fact' and v.last_modified_at >= window_start and v.last_modified_at < window_end)
"""


# 4 ------------------------------------------------------------------------------ unparseable records


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    parsed = rejects.parse(table(spark, sf, "user_file"), "raw_line", USER_FIELDS, keep=["line_id"], line_no="line_no", wanted=())
    return rejects.rejected(parsed).select("line_id", "reason")


P4_FOUND = "with " + oracle.RECORDS + ", " + oracle.times(oracle.DELETED) + """
select line_id, reason from records where reason is not null union all select row_id, 'deleted_at' from instants where not readable and v <> ''
"""


def p4_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """The loadable records as users."""
    return rejects.load(table(spark, sf, "user_file"), "raw_line", USER_FIELDS, zone=zones(spark, sf), zone_key="tenant_id", keep=["line_id"], line_no="line_no")


# 5 --------------------------------------------------------------------------------- attribute history


def _versions(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    cols = ["id", "tenant_id", "user_id", "user_account_state_type_id", "hr_user_account_state_type_id", "preferences", "start_at", "last_modified_at"]
    attributes = ["user_account_state_type_id", "hr_user_account_state_type_id", "preferences"]
    return history.versions(table(spark, sf, "user_dimension").select(*cols), keys=["tenant_id", "user_id"], at="start_at", newest=["last_modified_at", "id"], attributes=attributes, json=["preferences"], keep=keep)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _versions(spark, sf, "id").select("tenant_id", "user_id", "version", "id")


def p5_history(spark: SparkSession, sf: str) -> DataFrame:
    """The versions with the period each was valid."""
    return _versions(spark, sf, "user_account_state_type_id", "hr_user_account_state_type_id", "preferences").select("tenant_id", "user_id", "version", "user_account_state_type_id", "hr_user_account_state_type_id", "preferences", "valid_from", "valid_to")


def p5_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """History from a snapshot per quarter of the users observed in it: those not observed in the next one are deleted then."""
    u = table(spark, sf, "user_dimension").select("id", "tenant_id", "user_id", "start_at", "last_modified_at", F.date_trunc("quarter", "start_at").cast("timestamp_ntz").alias("quarter"), "user_account_state_type_id", "hr_user_account_state_type_id")
    states = ["user_account_state_type_id", "hr_user_account_state_type_id"]
    last = u.groupBy("tenant_id", "user_id", "quarter").agg(F.max(F.struct("start_at", "last_modified_at", "id", *states)).alias("s"))
    return history.from_snapshots(last.select("tenant_id", "user_id", "quarter", "s.*"), keys=["tenant_id", "user_id"], taken_at="quarter", attributes=states)


_P5 = """
with d as (
  select *, case when preferences is null then '{}' else
    (select '{' || coalesce(string_agg(to_json(k)::varchar || ':' || (preferences::json -> ('$."' || k || '"'))::varchar, ',' order by k), '') || '}' from unnest(json_keys(preferences::json)) t(k)) end as prefs
  from user_dimension
  qualify row_number() over (partition by tenant_id, user_id, start_at order by last_modified_at desc, id desc) = 1
), l as (
  select *, row_number() over w as rn, lag(user_account_state_type_id) over w as a, lag(hr_user_account_state_type_id) over w as b, lag(prefs) over w as p
  from d window w as (partition by tenant_id, user_id order by start_at)
), o as (
  select * from l where rn = 1 or a is distinct from user_account_state_type_id or b is distinct from hr_user_account_state_type_id or p is distinct from prefs
), v as (
  select *, cast(row_number() over w as integer) as vn, lead(start_at) over w as nxt from o window w as (partition by tenant_id, user_id order by start_at)
)
"""
P5_FOUND = _P5 + "select tenant_id, user_id, vn as version, id from v"
P5_HISTORY = _P5 + "select tenant_id, user_id, vn as version, user_account_state_type_id, hr_user_account_state_type_id, preferences, start_at as valid_from, nxt as valid_to from v"
P5_SNAPSHOTS = """
with q as (
  select tenant_id, user_id, user_account_state_type_id as a, hr_user_account_state_type_id as b, date_trunc('quarter', start_at)::timestamp as t from user_dimension where start_at is not null
  qualify row_number() over (partition by tenant_id, user_id, t order by start_at desc, last_modified_at desc nulls last, id desc) = 1
), n as (
  select *, dense_rank() over (order by t) as n from q
), l as (
  select *, lag(n) over w as pn, lag(a) over w as pa, lag(b) over w as pb, lead(n) over w as nn from n window w as (partition by tenant_id, user_id order by n)
), e as (
  select tenant_id, user_id, a, b, n, false as gone from l where pn is distinct from n - 1 or pa is distinct from a or pb is distinct from b
  union all
  select tenant_id, user_id, null, null, n + 1, true from l where nn is distinct from n + 1 and n < (select max(n) from n)
), v as (
  select *, lead(n) over w as later, coalesce(lead(gone) over w, false) as deleted from e window w as (partition by tenant_id, user_id order by n)
), times as (select distinct n, t from n)
select tenant_id, user_id, a as user_account_state_type_id, b as hr_user_account_state_type_id, x.t as valid_from, y.t as valid_to, deleted
from v join times x on x.n = v.n left join times y on y.n = v.later where not gone
"""


# 7 ------------------------------------------------------------------------------- dangling references


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "visits_fact").withColumn("period", (F.floor(F.col("date_dimension_id") / 100)).cast("int"))
    stage = table(spark, sf, "visits_file_fact_stage").withColumn("period", (F.floor(F.col("date_dimension_date_id") / 100)).cast("int"))
    users, tenants, features = table(spark, sf, "user_dimension"), table(spark, sf, "tenant_dimension"), table(spark, sf, "feature_type")
    name = lambda df, t, c, k: df.select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.col(k).alias("row_id"), "period", "kind")
    out = name(orphans.find(facts, ref="user_dimension_id", keep=["id", "period"], parents=users, parent_key="id", changed="last_modified_at", parent_changed="last_modified_at"), "visits_fact", "user_dimension_id", "id")
    out = out.unionByName(name(orphans.find(facts, ref="tenant_dimension_id", keep=["id", "period"], parents=tenants, parent_key="id", changed="last_modified_at", parent_changed="last_modified_at"), "visits_fact", "tenant_dimension_id", "id"))
    return out.unionByName(name(orphans.find(stage, ref="feature_type_name", keep=["line_id", "period"], parents=features, parent_key="name", text=True), "visits_file_fact_stage", "feature_type_name", "line_id"))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans per table, column and period."""
    return orphans.report(p7_found(spark, sf), ["table_name", "column_name", "period"])


P7_FOUND = """
with r as (
  select 'visits_fact' as table_name, 'user_dimension_id' as column_name, f.id as row_id, cast(f.date_dimension_id // 100 as integer) as period,
    case when d.id is null then 'missing' when d.last_modified_at > f.last_modified_at then 'late' end as kind
  from visits_fact f left join user_dimension d on f.user_dimension_id = d.id where f.user_dimension_id is not null
  union all
  select 'visits_fact', 'tenant_dimension_id', f.id, cast(f.date_dimension_id // 100 as integer),
    case when d.id is null then 'missing' when d.last_modified_at > f.last_modified_at then 'late' end
  from visits_fact f left join tenant_dimension d on f.tenant_dimension_id = d.id where f.tenant_dimension_id is not null
  union all
  select 'visits_file_fact_stage', 'feature_type_name', s.line_id, cast(s.date_dimension_date_id // 100 as integer), case when t.id is null then 'missing' end
  from visits_file_fact_stage s left join feature_type t on lower(regexp_replace(s.feature_type_name, '^\\s+|\\s+$', '', 'g')) = lower(trim(t.name))
  where regexp_replace(s.feature_type_name, '^\\s+|\\s+$', '', 'g') <> ''
)
"""
P7_REPORT = P7_FOUND + "select table_name, column_name, period, kind, count(*) as n_refs from r where kind is not null group by all"
P7_FOUND = P7_FOUND + "select * from r where kind is not null"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (p1_found, p1_state, p1_held, p2_found, p2_attributes, p3_found, p3_loaded, p4_found, p4_loaded, p5_found, p5_history, p5_snapshots, p6_found, p7_found, p7_report)
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p2_attributes": P2_ATTRIBUTES, "p4_found": P4_FOUND, "p6_found": P6_FOUND, "p1_found": P1_FOUND, "p1_state": P1_STATE, "p1_held": P1_HELD, "p3_found": P3_FOUND, "p3_loaded": P3_LOADED, "p5_found": P5_FOUND, "p5_history": P5_HISTORY, "p5_snapshots": P5_SNAPSHOTS, "p7_found": P7_FOUND, "p7_report": P7_REPORT}
