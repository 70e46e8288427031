"""History of entity attributes from snapshots or observations.

Consecutive snapshots are differenced by one null-safe full outer join: a row of snapshot n meets
the row of the same entity in snapshot n - 1. What has no earlier side was inserted, what differs was
changed, what has no later side was deleted; the changes, put together, are the history, and a
version is valid until the next one begins.

Entities of very many rows are numbered in buckets of time first and per entity over buckets
afterwards, so one that holds a third of all rows is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from dimforge.functions.merge import comparable
from dimforge.functions.names import all_columns, col, dealt, free, require
from dimforge.operators.scan import LARGE, large_keys
from dimforge.session import materialise


def canonical_json(c: Column) -> Column:
    """JSON text with keys sorted at every level and no blanks; null and blank give {}; text that isn't JSON stays as it is."""
    text = F.when(c.isNull() | (F.trim(c) == ""), F.lit("{}")).otherwise(c)
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def _same(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b):
        out = out & x.eqNullSafe(y)
    return out


def diff_snapshots(snapshots: DataFrame, keys: Sequence[str], number: str, attributes: Sequence[str], last: Column | None = None) -> DataFrame:
    """What happened between each snapshot and the one before: keys, `number`, `event`, and the other columns.

    `snapshots` holds one row per entity (`keys`, nulls equal) and snapshot; `number` counts snapshots
    without gaps. `event` is inserted, changed, unchanged or deleted; a deleted entity has the number
    of the first snapshot it is missing from, and the attributes it had; columns that aren't `attributes` are null then. `last` is
    the number of the latest snapshot: what is in it isn't deleted afterwards. None: every entity's last row is followed by a deleted one.
    Empty in, empty out.

    Rows meet by (entity, number) in one full outer join. Both sides are the same rows; where these are dealt
    out by entity already (as a single column, see :func:`entity`), they are not moved again.
    """
    require(snapshots, *keys, number, *attributes)
    e = entity_name(snapshots)
    rows = snapshots if e in snapshots.columns else snapshots.withColumn(e, entity(keys))
    extra = [c for c in snapshots.columns if c not in keys and c not in (number, e)]
    was = {c: f"was{i}" for i, c in enumerate(dict.fromkeys(attributes))}
    now = {c: f"now{i}" for i, c in enumerate(extra)}
    at = col(number).cast("long")
    here = rows.select(F.col(e).alias("e"), at.alias("n"), *[col(c).alias(n) for c, n in now.items()])
    # Asking for all columns makes this side the same exchange as the other.
    before = rows.where(all_columns(rows)).select(F.col(e).alias("pe"), (at + 1).alias("pn"), *[col(c).alias(n) for c, n in was.items()])
    j = here.join(before, (F.col("e") == F.col("pe")) & (F.col("n") == F.col("pn")), "full_outer")
    gone, new = F.col("e").isNull(), F.col("pe").isNull()
    same = _same([F.col(now[a]) for a in was], [F.col(w) for w in was.values()])
    j = j.withColumn("event", F.when(gone, "deleted").when(new, "inserted").when(same, "unchanged").otherwise("changed"))
    if last is not None:
        j = j.where(~gone | (F.col("pn") <= last))
    who = F.coalesce("e", "pe")
    return j.select(
        *[who.getField(f"k{i}").alias(k) for i, k in enumerate(keys)], F.coalesce("n", "pn").alias(number), "event",
        *[(F.coalesce(F.col(now[c]), F.when(gone, F.col(was[c]))) if c in was else F.col(now[c])).alias(c) for c in extra], *([who.alias(e)] if e in snapshots.columns else []),
    )


def entity(keys: Sequence[str]) -> Column:
    """The keys as one value: structs are equal where all fields are, nulls too, so plain joins and exchanges on it are null-safe."""
    return F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def entity_name(df: DataFrame) -> str:
    return "__entity" if "__entity" in df.columns else free(df.columns, "__entity")[0]


def _bucketed(df: DataFrame, keys: Sequence[str], at: str, tie: Sequence[Column], bucket: str, place: str, following: str | None = None, rank: bool = False, share: bool = False) -> DataFrame:
    """Add `place`, the row's number (with `rank`, its rank) within its `keys` by `at`; and `following`, the next row's `at`.

    Counted within (keys, bucket), then moved on by what the entity's earlier buckets hold. With `share`
    what makes `df` runs once, for one more shuffle of it: better if that is more than a few steps.
    """
    if share:
        df = dealt(df, *keys, bucket)
    local, base, after = free(df.columns, "__local", "__base", "__after")
    inner = Window.partitionBy(*[col(k) for k in keys], col(bucket)).orderBy(col(at), *tie)
    counted = df.withColumn(local, (F.rank() if rank else F.row_number()).over(inner))
    if following:
        counted = counted.withColumn(following, F.lead(col(at)).over(inner))
    names = [f"__k{i}" for i in range(len(keys))]
    sums = (df.where(all_columns(df)) if share else df).groupBy(*[col(k).alias(n) for k, n in zip(keys, names)], col(bucket).alias("__b")).agg(F.count(F.lit(1)).alias("__n"), F.min(col(at)).alias("__first"))
    outer = Window.partitionBy(*names).orderBy("__b")
    sums = sums.select(*names, "__b", F.coalesce(F.sum("__n").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(base), F.lead("__first").over(outer).alias(after))
    on = _same([*[col(k) for k in keys], col(bucket)], [*[F.col(n) for n in names], F.col("__b")])
    j = counted.join(sums, on, "inner")
    cols = [col(c) for c in df.columns] + [(F.col(local) + F.col(base)).cast("int").alias(place)]
    if following:
        cols.append(F.coalesce(col(following), F.col(after)).alias(following))
    return j.select(*cols)


def versions(observed: DataFrame, *, keys: Sequence[str], at: str, newest: Sequence[str], attributes: Sequence[str], json: Sequence[str] = (), keep: Sequence[str] | None = None, bucket: str = "day", large: int = LARGE) -> DataFrame:
    """The distinct versions of each entity, from observations: the opening row's columns (keys, `at` and `keep`; all, for None), `version`, `valid_from`, `valid_to`.

    Of rows equal in `keys` and `at` the greatest by `newest` counts. In order of `at`, a row opens a
    version if it is the entity's first or differs from the one before in `attributes`; null is a
    value, and columns named in `json` are compared as objects (null is the empty object). `valid_to`
    is when the next version begins, null for the current one. Rows without `at` can't be placed and
    are left out; a null key is an entity like others.

    An entity's k-th observation is its part of snapshot k. Entities of more than `large` rows are told
    first, by a count combined on the map side; their rows, spread by `bucket` (a date_trunc unit), take a
    longer way to the same result. The others are dealt out by entity once, and neither numbering nor the
    outer join moves them again.
    """
    require(observed, *keys, at, *newest, *attributes)
    for c in ("version", "valid_from", "valid_to"):
        if c in observed.columns and c in (*keys, at, *newest, *attributes):
            raise ValueError(f"{c} is a result column")
    data = observed.drop("version", "valid_from", "valid_to")
    kept = [c for c in data.columns if c not in keys and c != at] if keep is None else [c for c in keep if c not in keys and c != at]
    kinds = dict(data.dtypes)
    e, b, event, number, many, t = free(data.columns, "__entity", "__bucket", "event", "__number", "__many", "__at")
    new, own = [f"__new{i}" for i in range(len(newest))], [f"__own{i}" for i in range(len(kept))]
    compared = [f"__cmp{i}" for i in range(len(attributes))]
    forms = [canonical_json(col(a)) if a in json else comparable(col(a)) if kinds[a].startswith("map<") else col(a) for a in attributes]
    # Only what is needed, under names of its own, so that all branches below ask the same of one exchange.
    rows = data.where(col(at).isNotNull()).select(entity(keys).alias(e), col(at).alias(t), *[col(c).alias(n) for c, n in zip(newest, new)], *[f.alias(n) for f, n in zip(forms, compared)], *[col(c).alias(n) for c, n in zip(kept, own)])
    hot = large_keys(rows, F.col(e), large)
    back = dict(zip([at, *kept], [t, *own])) | {k: None for k in keys}
    out = [F.col(e)[f"k{list(keys).index(c)}"].alias(c) if c in keys else F.col(back[c]).alias(c) for c in data.columns if c in back]

    def opened(placed: DataFrame) -> DataFrame:
        """The change events: openings, and an end after each entity's last row."""
        return diff_snapshots(placed, [], number, compared).where("event <> 'unchanged'")

    def newest_first(*by: str) -> WindowSpec:
        return Window.partitionBy(*by).orderBy(*[F.col(n).desc_nulls_last() for n in new])

    common = (rows if hot is None else rows.join(hot, F.col(e) == F.col("hot"), "left_anti")).repartition(F.col(e))
    single = common.withColumn(b, F.row_number().over(newest_first(e, t))).where((F.col(b) == 1) & all_columns(common)).drop(b)
    placed = single.withColumn(number, F.row_number().over(Window.partitionBy(e).orderBy(t)))
    events = Window.partitionBy(e).orderBy(number)
    spans = opened(placed).withColumn("version", F.row_number().over(events)).withColumn("valid_to", F.lead(t).over(events))
    usual = spans.where(F.col(event) != "deleted").select(*out, "version", F.col(t).alias("valid_from"), "valid_to")

    if hot is None:
        return usual
    spread = rows.join(hot, F.col(e) == F.col("hot"), "left_semi").withColumn(b, F.date_trunc(bucket, F.col(t)))
    single = spread.withColumn(many, F.row_number().over(newest_first(e, b, t))).where(F.col(many) == 1).drop(many)
    changes = opened(_bucketed(single, [e], t, [], b, number)).where(F.col(event) != "deleted").drop(number, event)
    numbered = _bucketed(changes, [e], t, [], b, "version", "valid_to")
    return usual.unionByName(numbered.select(*out, "version", F.col(t).alias("valid_from"), "valid_to"))


def from_snapshots(snapshots: DataFrame, *, keys: Sequence[str], taken_at: str, attributes: Sequence[str]) -> DataFrame:
    """History from periodic snapshots: keys, attributes, `valid_from`, `valid_to`, `deleted`.

    Every distinct `taken_at` is a snapshot of the whole table. An entity missing from a snapshot was
    deleted then; that closes its version, and if it appears again a new one begins. Of several rows of
    an entity in one snapshot the greatest counts; rows without `taken_at` are in none. The list of snapshot
    times (not of rows) is numbered in one task, and an entity has at most one row per snapshot.
    """
    require(snapshots, *keys, taken_at, *attributes)
    kinds = dict(snapshots.dtypes)
    times = snapshots.where(col(taken_at).isNotNull()).select(col(taken_at).alias("__t")).distinct()
    times = materialise(times.select("__t", F.row_number().over(Window.orderBy("__t")).alias("__n")), "snapshots")
    maps = [a for a in attributes if kinds[a].startswith("map<")]
    best = F.max(F.struct(*[(comparable(col(a)) if a in maps else col(a)).alias(f"a{i}") for i, a in enumerate(attributes)]))
    one = snapshots.where(col(taken_at).isNotNull()).groupBy(entity(keys).alias("__entity"), col(taken_at).alias("__t")).agg(best.alias("__a"))
    cols = [f"__a{i}" for i in range(len(attributes))]
    numbered = one.join(times, "__t").select("__entity", "__n", *[F.col("__a")[f"a{i}"].alias(c) for i, c in enumerate(cols)])
    named = numbered.select(*[F.col("__entity")[f"k{i}"].alias(f"__k{i}") for i in range(len(keys))], "__n", *cols)
    events = diff_snapshots(named, [f"__k{i}" for i in range(len(keys))], "__n", cols, times.agg(F.max("__n")).scalar()).where("event <> 'unchanged'")
    w = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__t")
    spans = events.join(times, "__n").withColumn("valid_to", F.lead("__t").over(w)).withColumn("__next", F.lead("event").over(w))
    back = [(F.map_from_entries(F.col(c)) if a in maps else F.col(c)).alias(a) for a, c in zip(attributes, cols)]
    return spans.where("event <> 'deleted'").select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], *back, F.col("__t").alias("valid_from"), "valid_to", F.coalesce(F.col("__next") == "deleted", F.lit(False)).alias("deleted"))
