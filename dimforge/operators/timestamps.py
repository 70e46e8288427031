"""Mixed timestamp notations and zones to one UTC instant, inside the JVM.

Every notation is part of one regular expression with named groups. It runs once per value,
as the pattern of a ``regexp_replace`` whose replacement lists the groups; the instant is then
assembled from integers (days from the civil calendar, then microseconds), and only wall times
consult the rules of a zone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dimforge.functions.names import col, free, require

# English month and weekday names, and zone abbreviations with one customary meaning, in
# minutes east of Greenwich.
_MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_MONTH_ORDER = "janfebmaraprmayjunjulaugsepoctnovdec"
_WEEKDAYS = "mon(?:day)?|tue(?:s|sday)?|wed(?:nesday)?|thu(?:r|rs|rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?"
_WEEKDAY_ORDER = "thufrisatsunmontuewed"  # 1970-01-01 was a Thursday
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "brt": -180,
    "jst": 540, "kst": 540, "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
}

_DATES = (
    r"(?<y1>\d{4})(?<sep>[-/.])(?<m1>\d{1,2})\k<sep>(?<d1>\d{1,2})",
    rf"(?:(?<w2>{_WEEKDAYS})\.?,?\s+)?(?<d2>\d{{1,2}})[-/ ](?<n2>{_MONTHS})\.?[-/ ](?<y2>\d{{4}}),?",
    rf"(?:(?<w3>{_WEEKDAYS})\.?,?\s+)?(?<n3>{_MONTHS})\.?\s+(?<d3>\d{{1,2}}),?\s+(?<y3>\d{{4}}),?",
)
_CLOCK = r"(?:t|:|\s+(?:at\s+)?)(?<h1>\d{1,2}):(?<i1>\d{2})(?::(?<s1>\d{2})(?:[.,](?<f1>\d+))?)?(?:\s*(?<ap>[ap])\.?m\.?)?"
_COMPACT = r"(?<y4>\d{4})(?<m4>\d{2})(?<d4>\d{2})(?:t|\s)?(?<h4>\d{2})(?<i4>\d{2})(?:(?<s4>\d{2})(?:[.,](?<f4>\d+))?)?"
_ZONE = r"(?:\s*(?<sign>[+-])(?<oh>\d{2})(?::?(?<om>\d{2}))?|\s*(?<abbr>[a-z]{1,5}))?(?:\s*\[(?<bz>[^\[\]]+)\]|\s+\(?(?<iana>[a-z_]+(?:/[a-z0-9_+-]+)+)\)?)?"
_COUNT = r"(?:(?<cs>\d{10})|(?<cm>\d{13})|(?<cu>\d{16})|(?<cn>\d{19}))\.(?<cf>\d+)"  # bare counts are told by their size
PATTERN = rf"(?is)^(?:{_COUNT}|(?:(?:{'|'.join(_DATES)}){_CLOCK}|{_COMPACT}){_ZONE})$"

#: What the replacement lists, in order; groups of different notations share a place.
_PARTS = (
    "${cs}", "${cm}", "${cu}", "${cn}", "${cf}",
    "${y1}${y2}${y3}${y4}", "${m1}${m4}", "${n2}${n3}", "${d1}${d2}${d3}${d4}", "${w2}${w3}",
    "${h1}${h4}", "${i1}${i4}", "${s1}${s4}", "${f1}${f4}", "${ap}",
    "${sign}", "${oh}", "${om}", "${abbr}", "${bz}${iana}",
)
_NAMES = ("cs", "cm", "cu", "cn", "cf", "y", "m", "n", "d", "w", "h", "i", "s", "f", "ap", "sign", "oh", "om", "abbr", "zone")
_MARK = "\x01"
_US = 1_000_000
_DAY = 86_400 * _US


def known_zones(spark: SparkSession) -> list[str]:
    """Zone names that the JVM's time zone data has; asked once, a few hundred names."""
    try:
        names = spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()
        return sorted(str(z) for z in names)
    except Exception:  # a session without a gateway
        from zoneinfo import available_timezones

        return sorted(available_timezones())


def _lookup(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def days_from_civil(y: str, m: str, d: str) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, given as SQL expressions, by integer arithmetic.

    Years are counted from March, so that the leap day is a year's last.
    """
    year = f"({y} - if({m} <= 2, 1, 0))"
    day = f"((153 * ({m} + if({m} > 2, -3, 9)) + 2) div 5 + {d})"
    return F.expr(f"{year} * 365 + {year} div 4 - {year} div 100 + {year} div 400 + {day} - 719469")


def month_length(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


def _in_zone(us: Column, zone: Column) -> Column:
    """Wall clock, in microseconds, of the instant `us` in `zone`."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def _settled(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns behind a one-row generator: the optimizer copies no filter on them below it.

    Filters pushed through layers of projections would repeat the layers' expressions, each time over.
    """
    row = F.struct(*[v.alias(n) for n, v in values.items()])
    return df.select("*", F.inline_outer(F.array(row)))


def _candidate(wall: Column, zone: Column, days: int) -> Column:
    """The instant at which clocks of `zone` show `wall`, by the offset in force `days` later."""
    then = wall + F.lit(days * _DAY)
    return wall - (_in_zone(then, zone) - then)


def normalise(df: DataFrame, value: str, zone: str | None = None, *, readable: str = "readable", instant: str = "epoch_us", plain: str | None = None, zones: list[str] | None = None) -> DataFrame:
    """Add to `df` whether `value` is a readable time and the one instant it denotes.

    Columns added: `readable` boolean (false for null, blank and anything that isn't a time),
    `instant` bigint microseconds since 1970 in UTC, null unless exactly one instant is denoted,
    and, if named, `plain` boolean: the value is bare whole epoch seconds. A zone or offset in the
    value holds; else the value is wall time in the zone named by column `zone`; with no (known)
    zone there it is readable but denotes no instant. Digits beyond microseconds are cut off.
    All other columns and rows are kept; no shuffle, no Python.
    """
    require(df, value, *([zone] if zone else []))
    given = df.columns
    for n in (readable, instant, plain):
        if n and n in given:
            raise ValueError(f"{n} is already a column")
    zones = zones if zones is not None else known_zones(df.sparkSession)
    text, whole, parts, t, wall, early, late = free([*given, readable, instant, plain or readable], "__text", "__whole", "__parts", "__time", "__wall", "__early", "__late")
    trimmed = F.regexp_replace(col(value).cast("string"), r"^\s+|\s+$", "")
    # Bare counts, the most usual notation, need no pattern: only digits give a number of their own length.
    out = df.withColumn(text, F.when(col(value).cast("string").rlike(r"^\s|\s$"), trimmed).otherwise(col(value).cast("string")))
    number_of = F.expr(f"try_cast(`{text}` as bigint)")
    size = F.length(F.col(text))
    sized = reduce(lambda a, n: a.when((size == n) & (number_of >= 10 ** (n - 1)), number_of), (13, 16, 19), F.when((size == 10) & (number_of >= 10**9), number_of))
    out = _settled(out, **{whole: sized})
    out = out.withColumn(parts, F.when(F.col(whole).isNull(), F.split(F.regexp_replace(F.col(text), PATTERN, _MARK + _MARK.join(_PARTS)), _MARK, -1)))
    out = out.withColumn(parts, F.when(F.size(parts) == len(_PARTS) + 1, F.col(parts)))
    p = {n: F.get(F.col(parts), F.lit(k + 1)) for k, n in enumerate(_NAMES)}

    def number(name: str) -> Column:
        return F.expr(f"try_cast(get(`{parts}`, {_NAMES.index(name) + 1}) as bigint)")

    def has(name: str) -> Column:
        return F.coalesce(p[name] != "", F.lit(False))

    def digits(name: str, n: int) -> Column:
        return F.rpad(F.substring(p[name], 1, n), n, "0").cast("long")

    def place(order: str, name: str) -> Column:
        return F.expr(f"(instr('{order}', lower(substring(get(`{parts}`, {_NAMES.index(name) + 1}), 1, 3))) + 2) div 3")

    w = F.col(whole)
    count = (
        F.when(w.isNotNull(), F.when(w < 10**10, w * _US).when(w < 10**13, w * 1000).when(w < 10**16, w).otherwise(F.expr(f"`{whole}` div 1000")))
        .when(has("cs"), number("cs") * _US + digits("cf", 6))
        .when(has("cm"), number("cm") * 1000 + digits("cf", 3))
        .when(has("cu"), number("cu"))
        .when(has("cn"), F.expr(f"try_cast(substring(get(`{parts}`, {_NAMES.index('cn') + 1}), 1, 16) as bigint)"))
    )
    hour12 = number("h") % 12 + F.when(F.lower(p["ap"]) == "p", 12).otherwise(0)
    abbreviated = F.when(has("abbr"), _lookup(ABBREVIATIONS)[F.lower(p["abbr"])])
    minutes = F.when(has("om"), number("om")).otherwise(0)
    # One struct, settled: the steps after it read its fields, so nothing is computed twice.
    dated = F.when(
        F.col(parts).isNotNull() & ~has("cf"),
        F.struct(
            number("y").alias("y"), F.when(has("m"), number("m")).otherwise(place(_MONTH_ORDER, "n")).alias("m"), number("d").alias("d"),
            F.when(has("ap"), hour12).otherwise(number("h")).alias("h"), number("i").alias("i"), F.when(has("s"), number("s")).otherwise(0).cast("long").alias("s"), digits("f", 6).alias("us"),
            F.when(has("w"), place(_WEEKDAY_ORDER, "w") - 1).alias("w"),
            F.when(has("sign"), (number("oh") * 60 + minutes) * F.when(p["sign"] == "-", -1).otherwise(1)).otherwise(abbreviated).alias("offset"),
            (~has("ap") | number("h").between(1, 12)).alias("clock_ok"),
            F.when(has("sign"), (number("oh") <= 18) & (minutes <= 59)).when(has("abbr"), abbreviated.isNotNull()).otherwise(F.lit(True)).alias("offset_ok"),
            F.when(has("zone"), p["zone"]).alias("zone"),
        ),
    )
    counted, bare = free([*out.columns, t], "__count", "__bare")
    out = _settled(out, **{t: dated, counted: count, bare: w.isNotNull() & (w < 10**10)})
    f = lambda n: F.col(t)[n]
    exists = (f("y") >= 1) & f("m").between(1, 12) & (f("d") >= 1) & (f("d") <= month_length(f("y"), f("m"))) & (f("h") <= 23) & (f("i") <= 59) & (f("s") <= 59) & f("clock_ok") & f("offset_ok")
    days = days_from_civil(f"`{t}`.y", f"`{t}`.m", f"`{t}`.d")
    shown = days * _DAY + ((f("h") * 60 + f("i")) * 60 + f("s")) * _US + f("us")
    right_day = f("w").isNull() | (F.pmod(days, F.lit(7)) == f("w"))
    fallback = F.when(col(zone).isin(zones), col(zone)) if zone else F.lit(None).cast("string")
    own = F.when(f("zone").isNull(), fallback).when(f("zone").isin(zones), f("zone"))
    (place_of,) = free(out.columns, "__zone")
    known = f("zone").isNull() | f("zone").isin(zones)
    out = _settled(out, **{wall: F.when(exists & right_day & known, shown), place_of: F.when(f("offset").isNull(), own)})
    wall_c, zone_c = F.col(wall), F.col(place_of)
    local = wall_c.isNotNull() & zone_c.isNotNull()
    # No zone changes twice within two days, so the offsets a day before and after are all there are.
    out = _settled(out, **{early: F.when(local, _candidate(wall_c, zone_c, -1)), late: F.when(local, _candidate(wall_c, zone_c, 1))})
    e, a = F.col(early), F.col(late)
    e_ok, a_ok = _in_zone(e, zone_c) == wall_c, _in_zone(a, zone_c) == wall_c
    result = (
        F.when(F.col(counted).isNotNull(), F.col(counted))
        .when(wall_c.isNotNull() & f("offset").isNotNull(), wall_c - f("offset") * 60 * _US)
        .when(local & (e == a), F.when(e_ok, e))
        .when(local, F.when(e_ok & ~a_ok, e).when(a_ok & ~e_ok, a))
    )
    results = {readable: F.col(counted).isNotNull() | wall_c.isNotNull(), instant: result.cast("long")}
    if plain:
        results[plain] = F.coalesce(F.col(bare), F.lit(False))
    return _settled(out, **results).select(*[col(c) for c in given], *[col(c) for c in results])
