"""Queries of the warehouse operators over the star-schema tables, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimforge import session
from dimforge.functions.merge import coalesce_last, coalesce_merge, json_to_map, map_union, merge_entries
from dimforge.operators import dimensions, facts, mapping
from dimforge.operators.dimensions import Join, Lookup
from dimforge.operators.facts import Member
from dimforge.plans import frames
from dimforge.plans.pattern import Pattern
from dimforge.schema import types
from dimforge.schema.model import Column, Table
from dimforge.sources import files

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None) -> Callable:
    def mark(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return mark


def day_key(c):
    return F.date_format(c, "yyyyMMdd").cast("int")


# ------------------------------------------------------------------------------------------ roll-ups


def _event_facts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(day_key("ts").alias("date_id"), "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("time_key"), F.floor(F.col("value") * 100).cast("long").alias("total"))


_FACTS = "with f as (select cast(strftime(ts, '%Y%m%d') as integer) as date_id, user_id, event_type, cast(floor(epoch(ts)) as bigint) as time_key, cast(floor(value * 100) as bigint) as total from events)"


@query(_FACTS + " select date_id, event_type, cast(sum(total) as bigint) as total, time_key - time_key % 3600 as time_key from f group by date_id, event_type, time_key - time_key % 3600")
def rollup_hourly(spark, sf):
    return facts.rollup(_event_facts(spark, sf), grain="hourly", date_key="date_id", keys=["event_type"], measures={"total": "sum"})


@query(_FACTS + " select date_id, event_type, cast(sum(total) as bigint) as total, cast(epoch(strptime(cast(date_id as varchar), '%Y%m%d')) as bigint) as time_key from f group by date_id, event_type")
def rollup_daily(spark, sf):
    hourly = rollup_hourly(spark, sf)
    return facts.rollup(hourly, grain="daily", date_key="date_id", keys=["event_type"], measures={"total": "sum"})


@query(
    "with f as (select date_trunc('month', o_orderdate) as m, o_orderpriority, cast(floor(o_totalprice * 100) as bigint) as total from orders) "
    "select cast(strftime(m, '%Y%m%d') as integer) as date_id, o_orderpriority, cast(sum(total) as bigint) as total, cast(epoch(m) as bigint) as time_key from f group by m, o_orderpriority"
)
def rollup_monthly(spark, sf):
    o = table(spark, sf, "orders").select(day_key("o_orderdate").alias("date_id"), "o_orderpriority", F.floor(F.col("o_totalprice") * 100).cast("long").alias("total"))
    return facts.rollup(o, grain="monthly", date_key="date_id", keys=["o_orderpriority"], measures={"total": "sum"})


@query(
    "with f as (select cast(strftime(date_trunc('month', l_shipdate), '%Y%m%d') as integer) as date_id, l_returnflag, l_quantity, l_linenumber, l_discount, cast(l_quantity as bigint) as q from lineitem) "
    "select date_id, l_returnflag, min(l_quantity) as l_quantity, max(l_discount) as l_discount, cast(sum(q) as bigint) as q, round(avg(l_linenumber), 6) as l_linenumber, cast(epoch(strptime(cast(date_id as varchar), '%Y%m%d')) as bigint) as time_key from f group by date_id, l_returnflag"
)
def measures_min_max_sum_avg(spark, sf):
    rows = table(spark, sf, "lineitem").select(day_key("l_shipdate").alias("date_id"), "l_returnflag", "l_quantity", "l_discount", F.col("l_quantity").cast("long").alias("q"), "l_linenumber")
    got = facts.rollup(rows, grain="monthly", date_key="date_id", keys=["l_returnflag"], measures={"l_quantity": "min", "l_discount": "max", "q": "sum", "l_linenumber": "average"})
    return got.withColumn("l_linenumber", F.round("l_linenumber", 6))


@query("select o_orderkey, o_custkey, cast(epoch(o_orderdate) as bigint) as time_key, 'y' || strftime(o_orderdate, '%Y') || 'm' || strftime(o_orderdate, '%m') as period from orders where o_orderdate >= timestamp '1996-03-01' and o_orderdate < timestamp '1996-06-01'")
def partition_prune(spark, sf):
    o = table(spark, sf, "orders").where((F.col("o_orderdate") >= F.lit("1996-03-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1996-06-01").cast("timestamp_ntz")))
    return facts.with_period(o.select("o_orderkey", "o_custkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("time_key")))


# ----------------------------------------------------------------------------- ledger and its history


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        "user_id", F.col("ts").alias("start_at"), F.col("event_id").cast("string").alias("source_uuid"), F.when(F.col("event_id") % 10 == 0, 0).otherwise(1).alias("delta"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("state"), F.when(F.col("event_id") % 4 != 0, F.floor("value").cast("int")).alias("level"),
    )


_LEDGER = """
with led as (
  select user_id, ts as start_at, cast(event_id as varchar) as source_uuid, case when event_id % 10 = 0 then 0 else 1 end as delta,
    case when event_id % 3 <> 0 then event_type end as state, case when event_id % 4 <> 0 then cast(floor(value) as integer) end as level
  from events
), fw as (
  select *, sum(case when delta = 0 then 1 else 0 end) over (partition by user_id order by start_at, delta, source_uuid) as g from led
), fm as (
  select user_id, start_at, source_uuid, g, last_value(state ignore nulls) over w as state, last_value(level ignore nulls) over w as level
  from fw window w as (partition by user_id, g order by start_at, source_uuid)
), fwd as (
  select user_id, state, level, start_at from fm qualify row_number() over (partition by user_id, start_at order by source_uuid desc, g) = 1
), bw as (
  select *, sum(case when delta = 0 then 1 else 0 end) over (partition by user_id order by start_at desc, delta, source_uuid desc) as g from led
), bm as (
  select user_id, start_at, source_uuid, g, last_value(state ignore nulls) over w as state, last_value(level ignore nulls) over w as level
  from bw window w as (partition by user_id, g order by start_at desc, source_uuid desc)
), rev as (
  select user_id, state, level, start_at from bm qualify row_number() over (partition by user_id, start_at order by source_uuid desc, g) = 1
), con as (
  select f.user_id, coalesce(f.state, r.state) as state, coalesce(f.level, r.level) as level, f.start_at from fwd f join rev r on f.user_id = r.user_id and f.start_at = r.start_at
)"""
_THIN = """, {n}h as (
  select user_id, date_trunc('{unit}', start_at) as hr, state, level from con
  qualify row_number() over (partition by user_id, date_trunc('{unit}', start_at) order by start_at desc) = 1
), {n}l as (
  select *, row_number() over w as rn, lag(state) over w as ps, lag(level) over w as pl from {n}h window w as (partition by user_id order by hr)
), {n} as (
  select user_id, state, level, cast(hr as timestamp) as start_at from {n}l where rn = 1 or ps is distinct from state or pl is distinct from level
)"""
_HIST = _LEDGER + _THIN.format(n="thin", unit="hour") + """, hist as (
  select user_id, state, level, start_at, cast(rank() over w as integer) as version, lead(start_at) over w as end_at from thin window w as (partition by user_id order by start_at)
)"""
_ARGS = {"keys": ["user_id"], "attributes": ["state", "level"]}


@query(_LEDGER + " select * from fwd")
def snapshot_forward(spark, sf):
    return dimensions.snapshot(_ledger(spark, sf), **_ARGS)


@query(_LEDGER + " select * from rev where state is not null")
def snapshot_reverse(spark, sf):
    return dimensions.snapshot(_ledger(spark, sf), **_ARGS, required=["state"], backwards=True)


def _consolidated_states(spark, sf):
    """Written once: thinning out reads its states several times."""
    return session.materialise(dimensions.complete_states(_ledger(spark, sf), **_ARGS), "states")


@query(_LEDGER + _THIN.format(n="thin", unit="hour") + " select * from thin")
def dedup_hourly(spark, sf):
    return dimensions.deduplicate(_consolidated_states(spark, sf), **_ARGS, grain="hourly")


@query(_LEDGER + _THIN.format(n="thin", unit="day") + " select * from thin")
def dedup_daily(spark, sf):
    return dimensions.deduplicate(_consolidated_states(spark, sf), **_ARGS, grain="daily")


@query("select user_id, event_id, ts as start_at, cast(rank() over (partition by user_id order by ts) as integer) as version, lead(ts) over (partition by user_id order by ts) as end_at from events")
def relabel_versions(spark, sf):
    return dimensions.relabel(table(spark, sf, "events").select("user_id", "event_id", F.col("ts").alias("start_at")), keys=["user_id"])


@query(_HIST + " select * from hist")
def consolidate_dimension(spark, sf):
    return dimensions.consolidate(_ledger(spark, sf), **_ARGS)


# --------------------------------------------------------------------- upsert, references, staging


@query(
    "with t as (select c_custkey, c_name, c_nationkey, c_acctbal from customer where c_custkey % 3 <> 0), "
    "s as (select c_custkey, case when c_custkey % 5 <> 0 then upper(c_name) || '!' end as c_name, c_nationkey + 100 as c_nationkey, c_acctbal from customer where c_custkey % 2 = 0) "
    "select coalesce(t.c_custkey, s.c_custkey) as c_custkey, coalesce(s.c_name, t.c_name) as c_name, coalesce(s.c_nationkey, t.c_nationkey) as c_nationkey, coalesce(t.c_acctbal, s.c_acctbal) as c_acctbal from t full outer join s on t.c_custkey = s.c_custkey"
)
def bulk_upsert(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    source = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.concat(F.upper("c_name"), F.lit("!"))).alias("c_name"), (F.col("c_nationkey") + 100).alias("c_nationkey"), "c_acctbal")
    return dimensions.upsert(c.where("c_custkey % 3 <> 0"), source, ["c_custkey"], ["c_name", "c_nationkey"])


@query("select distinct p_brand as brand, coalesce(case when p_size % 7 <> 0 then p_type end, 'Unknown') as kind from part where p_brand is not null")
def insert_reference_values(spark, sf):
    p = table(spark, sf, "part").withColumn("kind", F.when(F.col("p_size") % 7 != 0, F.col("p_type")))
    some = p.where("p_partkey % 10 = 0").select(F.col("p_brand").alias("brand"), F.coalesce("kind", F.lit("Unknown")).alias("kind")).distinct()
    empty = spark.createDataFrame([], "id long, brand string, kind string")
    args = {"defaults": {"kind": "Unknown"}}
    there = dimensions.insert_references(empty, some, {"brand": "brand", "kind": "kind"}, **args)
    return dimensions.insert_references(there, p, {"brand": "p_brand", "kind": "kind"}, **args).select("brand", "kind")


@query("select count(*) as n, count(distinct p_type) as kinds, cast(min(1) as bigint) as first_id, count(distinct p_type) as last_id from (select distinct p_type from part)")
def surrogate_keys(spark, sf):
    """Keys of new members: from 1, without gaps, none twice."""
    m = dimensions.insert_references(spark.createDataFrame([], "id long, kind string"), table(spark, sf, "part"), {"kind": "p_type"})
    return m.agg(F.count("id").alias("n"), F.countDistinct("id").alias("kinds"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("select n.n_nationkey as nation_id, r.r_regionkey as region_id, c.c_custkey, c.c_name from customer c left join nation n on n.n_nationkey = case when c.c_custkey % 11 <> 0 then c.c_nationkey end left join region r on r.r_regionkey = n.n_regionkey")
def stage_dimension(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    c = c.withColumn("nation", F.when(F.col("c_custkey") % 11 != 0, F.col("c_nationkey")))
    first = dimensions.stage(c, [Lookup("nation_id", n, {"n_nationkey": "nation"}, "n_nationkey")], ["c_custkey", "c_name"])
    both = first.join(n.select(F.col("n_nationkey").alias("nation_id"), "n_regionkey"), "nation_id", "left")
    return dimensions.stage(both, [Lookup("region_id", r, {"r_regionkey": "n_regionkey"}, "r_regionkey")], ["nation_id", "c_custkey", "c_name"])


# ------------------------------------------------------------------------------------------- facts


@query("select o.o_custkey as customer_id, p.p_partkey as part_id, s.s_suppkey as supplier_id, l.l_orderkey, l.l_linenumber, l.l_quantity from lineitem l join orders o on l.l_orderkey = o.o_orderkey join part p on p.p_partkey = l.l_partkey and p.p_size > 10 join supplier s on s.s_suppkey = l.l_suppkey")
def stage_fact_inner(spark, sf):
    o, p, s = (table(spark, sf, t) for t in ("orders", "part", "supplier"))
    refs = [
        Member("customer_id", o, {"o_orderkey": "l_orderkey"}, surrogate="o_custkey"),
        Member("part_id", p.where("p_size > 10"), {"p_partkey": "l_partkey"}, surrogate="p_partkey"),
        Member("supplier_id", s, {"s_suppkey": "l_suppkey"}, surrogate="s_suppkey"),
    ]
    return facts.stage_fact(table(spark, sf, "lineitem"), refs, keep=["l_orderkey", "l_linenumber", "l_quantity"])


@query("select coalesce(c.c_custkey, -2) as customer_id, o.o_orderkey, o.o_totalprice from orders o left join (select * from customer where c_custkey % 4 <> 0) c on c.c_custkey = coalesce(case when o.o_orderkey % 6 <> 0 then o.o_custkey end, 1)")
def stage_fact_unknown(spark, sf):
    o = table(spark, sf, "orders").withColumn("cust", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_custkey")))
    refs = [Member("customer_id", table(spark, sf, "customer").where("c_custkey % 4 <> 0"), {"c_custkey": "cust"}, surrogate="c_custkey", default={"c_custkey": 1}, unknown=-2)]
    return facts.stage_fact(o, refs, keep=["o_orderkey", "o_totalprice"])


@query(_HIST + " select h.version as user_version, e.event_id, e.event_type from events e join hist h on h.user_id = e.user_id and ((e.ts >= h.start_at and (h.end_at is null or e.ts < h.end_at)) or (e.ts < h.start_at and h.version = 1))")
def stage_fact_temporal(spark, sf):
    e = table(spark, sf, "events").withColumn("time_key", F.unix_seconds(F.col("ts").cast("timestamp")))
    hist = session.materialise(consolidate_dimension(spark, sf), "dimension")
    refs = [Member("user_version", hist, {"user_id": "user_id"}, surrogate="version", temporal=True, half_open=True, sequential=True)]
    return facts.stage_fact(e, refs, time_key="time_key", keep=["event_id", "event_type"])


@query(_HIST + " select h.version as user_version, e.event_id, e.event_type from events e join hist h on h.user_id = e.user_id and ((date_trunc('second', e.ts) >= h.start_at and (h.end_at is null or date_trunc('second', e.ts) <= h.end_at)) or (e.ts < h.start_at and h.version = 1))")
def stage_fact_inclusive(spark, sf):
    """Ends included: a fact at the moment one version ends and the next begins comes with both."""
    e = table(spark, sf, "events").withColumn("time_key", F.unix_seconds(F.col("ts").cast("timestamp")))
    hist = session.materialise(consolidate_dimension(spark, sf), "dimension")
    refs = [Member("user_version", hist, {"user_id": "user_id"}, surrogate="version", temporal=True, sequential=True)]
    return facts.stage_fact(e, refs, time_key="time_key", keep=["event_id", "event_type"])


@query("select s.s_suppkey as supplier_id, n.n_nationkey as nation_id, l.l_orderkey, l.l_linenumber from lineitem l join supplier s on s.s_suppkey = l.l_suppkey join nation n on n.n_nationkey = coalesce(case when l.l_linenumber = 1 then 0 end, s.s_nationkey)")
def stage_fact_through(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("nation", F.when(F.col("l_linenumber") == 1, 0))
    refs = [
        Member("nation_id", table(spark, sf, "nation"), {"n_nationkey": "nation"}, name="nation", surrogate="n_nationkey", through={"n_nationkey": [("supplier", "s_nationkey")]}),
        Member("supplier_id", table(spark, sf, "supplier"), {"s_suppkey": "l_suppkey"}, name="supplier", surrogate="s_suppkey"),
    ]
    return facts.stage_fact(li, refs, keep=["l_orderkey", "l_linenumber"]).select("supplier_id", "nation_id", "l_orderkey", "l_linenumber")


@query("select l_orderkey as session_id, p.p_partkey as part_id, l_linenumber from lineitem l join (select * from part where p_brand is not null and p_size = 5) p on p.p_partkey = l.l_partkey")
def stage_fact_degenerate(spark, sf):
    refs = [Member("session_id", on={"": "l_orderkey"}, degenerate=True), Member("part_id", table(spark, sf, "part"), {"p_partkey": "l_partkey"}, surrogate="p_partkey", constant={"p_size": 5})]
    return facts.stage_fact(table(spark, sf, "lineitem"), refs, keep=["l_linenumber"])


@query(
    "select sn.n_name as supplier_nation_name, sr.r_name as supplier_region_name, cn.n_name as customer_nation_name, l.l_orderkey, l.l_linenumber, l.l_quantity "
    "from lineitem l left join supplier s on s.s_suppkey = l.l_suppkey left join nation sn on sn.n_nationkey = s.s_nationkey left join region sr on sr.r_regionkey = sn.n_regionkey "
    "left join orders o on o.o_orderkey = l.l_orderkey left join customer c on c.c_custkey = o.o_custkey left join nation cn on cn.n_nationkey = c.c_nationkey"
)
def denormalize_role_playing(spark, sf):
    li, s, n, r, o, c = (table(spark, sf, t) for t in ("lineitem", "supplier", "nation", "region", "orders", "customer"))
    supplier = Join("l_suppkey", s, {}, "s_suppkey", [Join("s_nationkey", n, {"supplier_nation_name": "n_name"}, "n_nationkey", [Join("n_regionkey", r, {"supplier_region_name": "r_name"}, "r_regionkey")])])
    customer = Join("l_orderkey", o, {}, "o_orderkey", [Join("o_custkey", c, {}, "c_custkey", [Join("c_nationkey", n, {"customer_nation_name": "n_name"}, "n_nationkey")])])
    return dimensions.denormalize(li, [supplier, customer], ["l_orderkey", "l_linenumber", "l_quantity"], order=())


@query("select n.n_name as nation_name, r.r_name as region_name, s.s_name from supplier s left join nation n on n.n_nationkey = s.s_nationkey left join region r on r.r_regionkey = n.n_regionkey order by all")
def denormalize_ordered(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return dimensions.denormalize(s, [Join("s_nationkey", n, {"nation_name": "n_name"}, "n_nationkey", [Join("n_regionkey", r, {"region_name": "r_name"}, "r_regionkey")])], ["s_name", "s_acctbal"], exclude=["s_acctbal"])


# -------------------------------------------------------------------------------------------- maps

_PROPS = "cast(json_extract(props, '$.k') as integer)"


@query(f"select event_id, {_PROPS} as k from events")
def map_json_extract(spark, sf):
    return mapping.project(table(spark, sf, "events"), {"event_id": F.col("event_id"), "k": F.get_json_object("props", "$.k").try_cast("int")})


@query(f"select event_id, unnest(range(1, {_PROPS} % 4 + 1)) as part_no from events")
def map_fanout(spark, sf):
    n = F.get_json_object("props", "$.k").try_cast("long") % 4
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1))), lambda i: F.struct(i.alias("part_no"))))
    return mapping.fan_out(table(spark, sf, "events"), parts, ["event_id"])


@query(f"select distinct event_type, {_PROPS} as k from events")
def map_distinct(spark, sf):
    return mapping.project(table(spark, sf, "events"), {"event_type": F.col("event_type"), "k": F.get_json_object("props", "$.k").try_cast("int")}, distinct=True)


_MAPPED = Table("event", "table", (Column("event_id", "long"), Column("kind", "string"), Column("k", "integer"), Column("note", "string", null=True)))


def _mapped(spark, sf):
    raw = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 9 != 0, F.col("event_type")).otherwise(F.lit(" ")).alias("kind"), F.get_json_object("props", "$.k").alias("k"))
    return mapping.split(mapping.coerced(raw, _MAPPED))


@query(f"select event_id, event_type as kind, {_PROPS} as k, cast(null as varchar) as note from events where event_id % 9 <> 0")
def map_accepted(spark, sf):
    return _mapped(spark, sf)[0]


@query("select event_id, 'missing kind' as reject from events where event_id % 9 = 0")
def map_rejects(spark, sf):
    return _mapped(spark, sf)[1].select("event_id", "reject")


@query(f"select event_id, upper(event_type) || '-' || cast({_PROPS} as varchar) as label from events where event_id % 2 = 0")
def map_python_function(spark, sf):
    def label(row):
        import json

        k = json.loads(row["props"])["k"]
        return {"event_id": row["event_id"], "label": f"{row['event_type'].upper()}-{k}"} if row["event_id"] % 2 == 0 else None

    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("label", T.StringType())])
    got = mapping.apply(table(spark, sf, "events").select("event_id", "event_type", "props"), label, schema)
    return got.where("error is null").select(F.col("event_id").cast("long").alias("event_id"), "label")


@query(
    "with x as (select user_id, event_id, 'k' as key, cast(json_extract(props, '$.k') as varchar) as value from events union all select user_id, event_id, event_type, cast(event_id as varchar) from events where event_id % 4 <> 0) "
    "select user_id, key, value from x qualify row_number() over (partition by user_id, key order by event_id desc) = 1"
)
def key_value_merge(spark, sf):
    """Maps of one or two keys, united by event: of each key the latest value."""
    own = F.when(F.col("event_id") % 4 != 0, F.create_map("event_type", F.col("event_id").cast("string")))
    merged = merge_entries(table(spark, sf, "events"), ["user_id"], map_union(json_to_map(F.col("props")), own), F.col("event_id"), "m")
    return merged.select("user_id", F.explode("m").alias("key", "value"))


@query("select user_id, arg_max(event_type, event_id) filter (where event_id % 3 <> 0) as event_type from events group by user_id")
def last_known_value(spark, sf):
    """The last value that isn't null, as an aggregate over each user's events in order."""
    e = table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("event_type")))
    return e.groupBy("user_id").agg(coalesce_last(F.col("v"), F.col("event_id")).alias("event_type"))


@query("select event_id, last_value(case when event_id % 3 <> 0 then event_type end ignore nulls) over (partition by user_id order by event_id) as event_type from events")
def running_last_value(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select("event_id", coalesce_merge(F.when(F.col("event_id") % 3 != 0, F.col("event_type")), w).alias("event_type"))


@query("select event_type || ':' || cast(user_id as varchar) as key, count(*) as n from events group by 1")
def mapreduce_count(spark, sf):
    lines = table(spark, sf, "events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("line"))
    return files.count_by_key(lines, "line")


@query(
    "with t as (select event_id, case event_id % 6 when 0 then '12abc' when 1 then ' 7' when 2 then '' when 3 then 'TRUE' when 4 then '0' else null end as v from events) "
    "select event_id, case when v is null or trim(v) = '' then null when v = '12abc' then 12 when v = ' 7' then 7 when v = 'TRUE' then 0 else 0 end as i, case when v = 'TRUE' then true when v = '0' then false end as b, case when trim(v) <> '' then v end as s from t"
)
def coerce_types(spark, sf):
    v = F.when(F.col("event_id") % 6 == 0, "12abc").when(F.col("event_id") % 6 == 1, " 7").when(F.col("event_id") % 6 == 2, "").when(F.col("event_id") % 6 == 3, "TRUE").when(F.col("event_id") % 6 == 4, "0")
    e = table(spark, sf, "events").select("event_id", v.alias("v"))
    return e.select("event_id", types.coerce(F.col("v"), "integer").alias("i"), types.coerce(F.col("v"), "boolean").alias("b"), types.coerce(F.col("v"), "string").alias("s"))


# ------------------------------------------------------------------------------------------ planner


def _targets(spark, sf):
    """Days with orders, as if each had a target file; every seventh isn't there."""
    o = table(spark, sf, "orders").select(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("at"), F.col("o_orderkey"))
    days = o.groupBy("at").agg(F.max("o_orderkey").alias("k"))
    return days.where(F.dayofmonth("at") % 7 != 0).select("at", F.timestamp_seconds(F.col("k") * 60).cast("timestamp_ntz").alias("mtime"))


def _sources(spark, sf):
    """Days with shipments, as if each had a source file; those of every 29th aren't there."""
    li = table(spark, sf, "lineitem").where(F.dayofmonth("l_shipdate") != 29).select(F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("at"), "l_orderkey")
    return li.groupBy("at").agg(F.timestamp_seconds(F.max("l_orderkey") * 60).cast("timestamp_ntz").alias("mtime"))


_PLAN = """
with ends as (select date_trunc('day', min(d))::timestamp as lo, date_trunc('day', max(d))::timestamp as hi from (select o_orderdate::timestamp as d from orders union all select l_shipdate::timestamp from lineitem)),
expected as (select unnest(generate_series(lo, hi, interval 1 day)) as "at" from ends),
months as (select distinct date_trunc('month', "at")::timestamp as "at" from expected),
t as (select date_trunc('day', o_orderdate)::timestamp as "at", make_timestamp(max(o_orderkey) * 60000000) as mtime from orders where day(o_orderdate) % 7 <> 0 group by 1),
s as (select date_trunc('day', l_shipdate)::timestamp as "at", make_timestamp(max(l_orderkey) * 60000000) as mtime from lineitem where day(l_shipdate) <> 29 group by 1),
missing as (select "at" from expected where "at" not in (select "at" from t)),
incomplete as (select "at" from expected where "at" not in (select "at" from s)),
stale as (select e."at" from expected e join t on t."at" = e."at" join s on s."at" = e."at" where s.mtime > t.mtime),
actionable as (select "at" from missing union select "at" from incomplete union select "at" from stale)
"""


def _expected(spark, sf):
    """Every day from the first to the last of the orders and shipments."""
    days = table(spark, sf, "orders").select(F.col("o_orderdate").alias("d")).unionByName(table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("d")))
    lo, hi = (F.date_trunc("day", f("d")).cast("timestamp_ntz") for f in (F.min, F.max))
    ends = days.agg(lo.alias("lo"), hi.alias("hi"))
    return ends.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("at"))


@query(_PLAN + "select \"at\" from expected")
def plan_generate(spark, sf):
    return _expected(spark, sf)


@query(_PLAN + "select \"at\" from missing")
def plan_missing(spark, sf):
    return frames.missing(_expected(spark, sf), _targets(spark, sf))


@query(_PLAN + "select t.\"at\", t.mtime from t join expected e on t.\"at\" = e.at")
def plan_existing(spark, sf):
    return frames.existing(_expected(spark, sf), _targets(spark, sf))


# A month counts with all its days, at the ends too; February of a common year has no 29th to lack.
@query(_PLAN + "select m.\"at\" from months m where day(last_day(m.\"at\")) <> (select count(*) from s where date_trunc('month', s.\"at\") = m.\"at\")")
def plan_incomplete(spark, sf):
    return frames.incomplete(frames.with_grain(_expected(spark, sf), "month"), "month", "day", _sources(spark, sf))


@query(_PLAN + "select \"at\" from stale")
def plan_stale(spark, sf):
    return frames.stale(frames.existing(_expected(spark, sf), _targets(spark, sf)), "day", "day", _sources(spark, sf))


@query(_PLAN + "select \"at\" from actionable")
def plan_actionable(spark, sf):
    return frames.actionable(_expected(spark, sf), _targets(spark, sf), "day", "day", _sources(spark, sf))


@query(_PLAN + "select \"at\" from actionable where \"at\" in (select \"at\" from s)")
def plan_updateable(spark, sf):
    return frames.updateable(_expected(spark, sf), _targets(spark, sf), "day", "day", _sources(spark, sf))


@query("with d as (select distinct date_trunc('day', o_orderdate)::timestamp as \"at\" from orders) select distinct \"at\" + n * interval 1 day as \"at\" from d, unnest([-2, -1, 0, 1, 2]) u(n)")
def plan_adjacent(spark, sf):
    days = table(spark, sf, "orders").select(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("at"))
    return frames.adjacent(days, "day", 2)


@query("select distinct date_trunc('month', o_orderdate)::timestamp as \"at\" from orders")
def plan_with_grain(spark, sf):
    return frames.with_grain(table(spark, sf, "orders").select(F.col("o_orderdate").alias("at")), "month")


@query("select '/log/y=' || strftime(o_orderdate, '%Y') || '/m=' || strftime(o_orderdate, '%m') || '/d=' || strftime(o_orderdate, '%d') as path, date_trunc('day', o_orderdate)::timestamp as \"at\" from orders where o_orderkey % 3 <> 0")
def pattern_bind(spark, sf):
    o = table(spark, sf, "orders")
    path = F.concat(F.lit("/log/y="), F.date_format("o_orderdate", "yyyy"), F.lit("/m="), F.date_format("o_orderdate", "MM"), F.lit("/d="), F.date_format("o_orderdate", "dd"))
    odd = F.when(F.col("o_orderkey") % 3 == 0, F.concat(path, F.lit("/part-0"))).otherwise(path)
    return frames.bind(o.select(odd.alias("path")), Pattern("/log/y=%Y/m=%m/d=%d"))


# ------------------------------------------------------------------------------------------- audits


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_partkey % 5 <> 0)")
def audit_foreign_keys(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return mapping.missing_parents(li, "l_partkey", table(spark, sf, "part").where("p_partkey % 5 <> 0"), "p_partkey")


@query("select o_custkey, o_orderpriority, count(*) as n_rows from orders group by 1, 2 having count(*) > 1")
def audit_unique(spark, sf):
    return mapping.duplicates(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"])


@query("select event_type, count(*) as n_rows from events where event_type not in ('click', 'view') group by 1")
def audit_enum(spark, sf):
    return mapping.outside(table(spark, sf, "events"), "event_type", ["click", "view"])


@query("select r_regionkey, r_name from region union all select -1, 'MISSING' where not exists (select 1 from region where r_regionkey = -1) union all select -2, 'UNKNOWN'")
def seed_rows(spark, sf):
    rows = spark.createDataFrame([(-1, "MISSING"), (-2, "UNKNOWN"), (0, "NOT USED")], "r_regionkey int, r_name string")
    once = mapping.seed(table(spark, sf, "region").select("r_regionkey", "r_name"), rows, ["r_regionkey"])
    return mapping.seed(once, rows, ["r_regionkey"])


@query("select date_trunc('minute', max(last_modified_at))::timestamp as last_modified_at from user_dimension")
def table_freshness(spark, sf):
    return mapping.freshness(table(spark, sf, "user_dimension"))


@query(" union all ".join(f"select '{c}' as \"column\", count(*) as n_rows, count(*) - count({c}) as n_null, cast(min({c}) as varchar) as least, cast(max({c}) as varchar) as greatest from user_dimension" for c in ("id", "tenant_id", "hr_user_account_state_type_id", "preferences")))
def table_statistics(spark, sf):
    return mapping.statistics(table(spark, sf, "user_dimension").select("id", "tenant_id", "hr_user_account_state_type_id", "preferences")).drop("n_distinct")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
