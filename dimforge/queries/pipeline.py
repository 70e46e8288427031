"""Queries of whole loads and of sources and sinks, and SQL that says the same."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimforge import session
from dimforge.functions import accesslog
from dimforge.operators import load, mapping, timestamps
from dimforge.queries import oracle, problems
from dimforge.queries.warehouse import table
from dimforge.schema import types
from dimforge.schema.model import Catalog, Column, Map, Reference, Table
from dimforge.sources import files, fs
from dimforge.sources.writers import Warehouse

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def mark(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return mark


def _folder(spark: SparkSession) -> str:
    return f"{session.work_dir(spark)}/query-{uuid.uuid4().hex}"


# ------------------------------------------------------------------------------------------ loads


def _catalog() -> Catalog:
    c = Catalog(w="postgres")
    c.w.dimension("feature", "mini", [Column("name", "string", unique=("name",))])
    c.w.dimension("tenant", "two", [Column("tenant_id", natural_key=True)])
    c.w.dimension("user", "two", [Column("tenant_id", natural_key=True), Column("user_id", "long", natural_key=True)])
    refs = [Reference(c.w.tenant_dimension, unknown=-2), Reference(c.w.user_dimension, unknown=-2), Reference(c.w.feature_type, unknown=-2)]
    c.w.fact("visits", [Column("line_id", "long"), Column("total", measure=True, aggregate="sum")], refs, grains=("hourly", "daily"), partition="y%Ym%m")
    return c


def _load(spark: SparkSession, sf: str, stage: DataFrame) -> DataFrame:
    """Facts of stage rows whose `time_key` has been made epoch seconds."""
    rows = stage.select(
        "line_id", F.col("tenant_dimension_tenant_id").alias("tenant.tenant_id"), F.col("tenant_dimension_tenant_id").alias("user.tenant_id"), F.col("user_dimension_user_id").alias("user.user_id"),
        F.col("feature_type_name").alias("feature.name"), F.col("time_key").cast("long").alias("time_key"), "total",
    )
    users = problems._versions(spark, sf, "id").select("id", "tenant_id", "user_id", "version", F.col("valid_from").alias("start_at"), F.col("valid_to").alias("end_at"))
    users = session.materialise(users, "users")  # the dimension as a load leaves it
    members = {"tenant_dimension": table(spark, sf, "tenant_dimension"), "user_dimension": users, "feature_type": table(spark, sf, "feature_type")}
    return load.load_fact(rows, _catalog().w.visits_hourly_fact, members, sequential=("user",))[0]


def _loaded(spark: SparkSession, sf: str) -> DataFrame:
    """All stage rows whose time denotes one instant, in any notation; :func:`load_rejects` has the others."""
    timed = problems.stage_instants(spark, sf, "user_dimension_user_id", "feature_type_name", "total").where("epoch_us is not null")
    return _load(spark, sf, timed.withColumn("time_key", F.expr("(epoch_us - pmod(epoch_us, 1000000)) div 1000000")))


def _rolled_up(loaded: DataFrame) -> DataFrame:
    from dimforge.operators import facts

    dated = loaded.withColumn("date_id", F.date_format(F.timestamp_seconds("time_key"), "yyyyMMdd").cast("int"))
    return facts.rollup(dated, grain="daily", date_key="date_id", keys=["tenant_dimension_id", "feature_type_id"], measures={"total": "sum"})


def _denormalized(spark: SparkSession, sf: str, loaded: DataFrame) -> DataFrame:
    members = {"tenant_dimension": table(spark, sf, "tenant_dimension"), "user_dimension": table(spark, sf, "user_dimension"), "feature_type": table(spark, sf, "feature_type")}
    flat = load.denormalize(loaded, _catalog().w.visits_hourly_fact, members, order=[], exclude=("user_dimension_tenant_id", "user_dimension_user_id", "time_key", "period"))
    return flat.select("tenant_dimension_tenant_id", "feature_type_name", "line_id", "total")


_LOADED = "with " + oracle.times(oracle.STAGE) + ", " + problems._P5.strip().removeprefix("with ") + """, s as (
  select line_id, tenant_dimension_tenant_id as tn, user_dimension_user_id as us, feature_type_name as ft, epoch_us // 1000000 as tk, make_timestamp(epoch_us // 1000000 * 1000000) as ts, total
  from visits_file_fact_stage join instants on row_id = line_id where epoch_us is not null
), facts as (
  select coalesce(t.id, -2) as tenant_dimension_id, coalesce(u.id, -2) as user_dimension_id, coalesce(f.id, -2) as feature_type_id, s.line_id, s.total, s.tk as time_key,
    'y' || strftime(s.ts, '%Y') || 'm' || strftime(s.ts, '%m') as period
  from s
  left join tenant_dimension t on t.tenant_id = s.tn and ((s.ts >= t.start_at and (t.end_at is null or s.ts <= t.end_at)) or (s.ts < t.start_at and t.version = 1))
  left join v u on u.tenant_id = s.tn and u.user_id = s.us and ((s.ts >= u.start_at and (u.nxt is null or s.ts <= u.nxt)) or (s.ts < u.start_at and u.vn = 1))
  left join feature_type f on f.name = s.ft
)
"""


@query(_LOADED + "select * from facts")
def load_fact_visits(spark, sf):
    return _loaded(spark, sf)


@query(_LOADED + "select tenant_dimension_id, feature_type_id, cast(strftime(make_timestamp(time_key * 1000000), '%Y%m%d') as integer) as date_id, cast(sum(total) as bigint) as total, time_key - time_key % 86400 as time_key from facts group by 1, 2, 3, 5")
def load_and_roll_up(spark, sf):
    return _rolled_up(_loaded(spark, sf))


@query(_LOADED + "select tenant_id as tenant_dimension_tenant_id, f.name as feature_type_name, x.line_id, x.total from facts x left join tenant_dimension t on t.id = x.tenant_dimension_id left join feature_type f on f.id = x.feature_type_id")
def load_and_denormalize(spark, sf):
    return _denormalized(spark, sf, _loaded(spark, sf))


@query("with " + oracle.times(oracle.STAGE) + "select row_id as line_id, case when readable then 'no single instant' else 'unreadable' end as reason from instants where epoch_us is null")
def load_rejects(spark, sf):
    """Stage rows that no load takes in: their time can't be read, or is no single instant."""
    reason = F.when(F.col("readable"), "no single instant").otherwise("unreadable")
    return problems.stage_instants(spark, sf).where("epoch_us is null").select("line_id", reason.alias("reason"))


@query(
    "select c_custkey, case when c_custkey % 3 = 0 then upper(c_name) else c_name end as c_name, c_mktsegment as segment from customer"
)
def load_dimension_customers(spark, sf):
    """Half of the customers are there, under other names; the file brings all, with names for two thirds of them."""
    c = Catalog(w="postgres")
    segment = c.w.dimension("segment", "mini", [Column("name", "string", unique=("name",))])
    target = c.w.dimension("customer", "one", [Column("c_custkey", "long", natural_key=True), Column("c_name", "string", null=True)], [Reference(segment, insert=True)])
    cust = table(spark, sf, "customer")
    there = cust.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit(None).cast("long").alias("segment_type_id"), "c_custkey", F.upper("c_name").alias("c_name"))
    rows = cust.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("c_name"), F.col("c_mktsegment").alias("segment.name"))
    loaded, after = load.load_dimension(rows, target, {"segment_type": spark.createDataFrame([], "id long, name string")}, there)
    named = after["segment_type"].select(F.col("id").alias("segment_type_id"), F.col("name").alias("segment"))
    return loaded.join(named, "segment_type_id", "left").select("c_custkey", "c_name", "segment")


# ------------------------------------------------------------------------------- sources and sinks

_NATION = Table("nation", "file", (Column("n_nationkey"), Column("n_name", "string"), Column("n_regionkey")))


@query("select n_nationkey, n_name || ', \"quoted\"' as n_name, n_regionkey from nation")
def csv_round_trip(spark, sf):
    where = _folder(spark)
    n = table(spark, sf, "nation").select(*[types.encode(F.concat("n_name", F.lit(', "quoted"')) if c.name == "n_name" else F.col(c.name), c.type).alias(c.name) for c in _NATION.columns])
    files.write_delimited(n, where)
    return mapping.split(mapping.coerced(files.read_delimited(spark, where, _NATION), _NATION))[0]


@query("select o_orderkey, o_custkey, cast(year(o_orderdate) as integer) as y from orders where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01'")
def partitioned_tsv_scan(spark, sf):
    where = _folder(spark)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_custkey").cast("string").alias("o_custkey"), F.year("o_orderdate").alias("y"))
    files.write_delimited(o, where, "hive", partition=["y"])
    t = Table("orders", "file", (Column("o_orderkey", "long"), Column("o_custkey", "long"), Column("y", partition=True)))
    return files.read_hive(spark, where, t).where("y = 1997").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), F.col("y").cast("int").alias("y"))


@query("select event_id, cast(json_extract(props, '$.k') as integer) as k from events")
def json_lines_scan(spark, sf):
    where = _folder(spark)
    table(spark, sf, "events").select(F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")))).write.text(where)
    return files.read_json_lines(spark, where, "event_id bigint, k int")


@query("select o_orderkey, case when year(o_orderdate) = 1996 and month(o_orderdate) = 2 then -o_custkey else o_custkey end as o_custkey, 'y' || strftime(o_orderdate, '%Y') || 'm' || strftime(o_orderdate, '%m') as period from orders")
def replace_one_period(spark, sf):
    return _replaced(spark, table(spark, sf, "orders"))


def _replaced(spark: SparkSession, orders: DataFrame) -> DataFrame:
    w = Warehouse(spark, _folder(spark))
    o = orders.select("o_orderkey", "o_custkey", F.concat(F.lit("y"), F.date_format("o_orderdate", "yyyy"), F.lit("m"), F.date_format("o_orderdate", "MM")).alias("period"))
    w.replace_periods("orders", o)
    w.replace_periods("orders", o.where("period = 'y1996m02'").withColumn("o_custkey", -F.col("o_custkey")))
    return w.read("orders").select("o_orderkey", "o_custkey", F.col("period").cast("string").alias("period"))


@query("select cast(year(o_orderdate) as integer) as y, cast(1 as bigint) as n_files, true as has_size from orders group by 1")
def file_listing(spark, sf):
    """Files of orders, one per year, listed without being read."""
    where = _folder(spark)
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    o.repartition("y").write.partitionBy("y").parquet(where)
    listed = fs.listing(spark, where).where("path like '%.parquet'").withColumn("y", F.regexp_extract("path", "/y=([0-9]+)/", 1).cast("int"))
    return listed.groupBy("y").agg(F.count("path").alias("n_files"), (F.min("size") > 0).alias("has_size"))


@query("select o_orderkey, epoch_us(timezone('America/New_York', o_orderdate + interval 300 minute)) as epoch_us from orders")
def local_to_utc(spark, sf):
    """Wall times of one zone as instants; none of these is skipped or repeated there."""
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format(F.expr("o_orderdate + interval 300 minutes"), "dd/MMM/yyyy:HH:mm:ss").alias("t"), F.lit("America/New_York").alias("z"))
    return timestamps.normalise(o, "t", "z").select("o_orderkey", "epoch_us")


_AGENTS = [
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36", "Chrome", "Windows 10", "Other"),
    ("Mozilla/5.0 (X11; Ubuntu; Linux x86_64; rv:109.0) Gecko/20100101 Firefox/115.0", "Firefox", "Ubuntu", "Other"),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 16_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/16.0 Mobile/15E148 Safari/604.1", "Mobile Safari", "iOS", "iPhone"),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Safari/605.1.15", "Safari", "Mac OS X", "Other"),
    ("something else", "Other", "Other", "Other"),
]


@query(
    f"with a(i, name, os_name, device) as (values {', '.join(str((i, *x[1:])) for i, x in enumerate(_AGENTS))}) "
    "select strftime(ts, '%Y%m%d') as date_key, user_id, name, os_name, device, cast(floor(epoch(ts)) as bigint) // 3600 * 3600 as time_key, count(*) as total "
    "from events join a on i = event_id % 5 where event_id % 7 <> 0 group by all"
)
def access_log_visits(spark, sf):
    """Log lines written from events (every seventh of another form), read back, parsed and counted by hour."""
    where = _folder(spark)
    agent = F.element_at(F.array(*[F.lit(x[0]) for x in _AGENTS]), (F.col("event_id") % 5 + 1).cast("int"))
    stamp = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    line = F.format_string('10.0.0.1 - %d [%s +0000] "GET /x/%d HTTP/1.1" 200 12 "-" "%s"', "user_id", stamp, "event_id", agent)
    odd = F.format_string('10.0.0.1 - - [%s +0000] "POST /x HTTP/1.1" 200 12 "-" "%s"', stamp, agent)
    table(spark, sf, "events").select(F.when(F.col("event_id") % 7 != 0, line).otherwise(odd)).write.text(where)
    return accesslog.hourly_visits(files.read_raw(spark, where))


@query("select event_id, event_type as kind, cast(json_extract(props, '$.k') as integer) + n as k, timestamp '1970-01-01' as seen from events, (values (0), (100)) t(n) where event_id % 3 <> 0")
def map_declared(spark, sf):
    """A map of the model, run: two rows of each event but every third, which the function gives nothing for."""
    source = Table("events", "file", (Column("event_id", "long"), Column("event_type", "string"), Column("props", "json")))
    target = Table("event", "table", (Column("event_id", "long"), Column("kind", "string"), Column("k"), Column("seen", "timestamp", default="epoch()")))

    def two(row):
        k = json.loads(row["props"])["k"]
        return None if row["event_id"] % 3 == 0 else [{"event_id": row["event_id"], "kind": row["event_type"], "k": k + n} for n in (0, 100)]

    rows = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"), "event_type", "props")
    return mapping.run_map(Map(source, target, two, distinct=True), rows)[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
