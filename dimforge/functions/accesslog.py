"""Lines of web servers' access logs, and what their user agents are; all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimforge.functions.names import col

# The line format (address, user, time, path, agent), and agents, systems and devices with the
# patterns that tell them. Of several that match the first counts.
LINE = r'^(\d+\.\d+\.\d+\.\d+) - (\d+) \[(.*?)\] "GET (.*?) HTTP/1.1" \d+ \d+ "-" "(.*?)"'
AGENTS = [
    ("Googlebot", "Googlebot"), ("Flock", "Flock/"), ("SeaMonkey", "SeaMonkey/"), ("Epiphany", "Epiphany/"), ("Konqueror", "Konqueror/"), ("Camino", "Camino/"), ("Iceweasel", "Iceweasel/"),
    ("Opera", "Opera|OPR/"), ("Edge", "Edge?/"), ("Chrome Mobile", "Chrome/.*Mobile|CriOS/"), ("Chrome", "Chrome/"), ("Firefox", "Firefox/"), ("IE", "MSIE |Trident/"),
    ("Android", "Android .*Version/"), ("Mobile Safari", "(?:iPhone|iPad|iPod).*Version/"), ("Safari", "Version/.* Safari/"), ("curl", "^curl/"),
]
SYSTEMS = [
    ("Windows 10", r"Windows NT 10\.0"), ("Windows 8.1", r"Windows NT 6\.3"), ("Windows 8", r"Windows NT 6\.2"), ("Windows 7", r"Windows NT 6\.1"), ("Windows Vista", r"Windows NT 6\.0"), ("Windows XP", r"Windows NT 5\.[12]|Windows XP"), ("Windows 2000", r"Windows NT 5\.0"), ("Windows", "Windows"),
    ("Android", "Android"), ("iOS", "iPhone|iPad|iPod"), ("Mac OS X", "Mac OS X"), ("Mac OS", "Macintosh|Mac_PowerPC"), ("Chrome OS", "CrOS "), ("Ubuntu", "Ubuntu"), ("Debian", "Debian"), ("Fedora", "Fedora"), ("Linux", "Linux"),
]
DEVICES = [("Spider", "Googlebot|bot/|Crawler"), ("iPhone", "iPhone"), ("iPad", "iPad"), ("iPod", "iPod")]


def _first(text: Column, table: list[tuple[str, str]]) -> Column:
    out = F.lit("Other")
    for name, pattern in reversed(table):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return F.when(text.isNull(), "Other").otherwise(out)


def user_agent(text: Column) -> Column:
    """A struct of name, os_name and device; Other where nothing known matches."""
    return F.struct(_first(text, AGENTS).alias("name"), _first(text, SYSTEMS).alias("os_name"), _first(text, DEVICES).alias("device"))


def parse(lines: DataFrame, line: str = "data") -> DataFrame:
    """The requests in `lines`: ip_address, user_id, created_at (UTC), path, user_agent. Lines of any other form, or without a time, are left out."""
    part = lambda i: F.regexp_extract(col(line), LINE, i)
    at = F.try_to_timestamp(part(3), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    got = lines.where(col(line).rlike(LINE)).select(part(1).alias("ip_address"), part(2).try_cast("long").alias("user_id"), at.cast("timestamp").alias("created_at"), part(4).alias("path"), part(5).alias("user_agent"))
    return got.where("created_at is not null")


def hourly_visits(lines: DataFrame, line: str = "data") -> DataFrame:
    """Requests counted by day, user, agent and hour: date_key, user_id, name, os_name, device, time_key, total; counted on the map side first."""
    r = parse(lines, line).select("user_id", "created_at", user_agent(F.col("user_agent")).alias("a"))
    s = F.unix_seconds("created_at")
    keys = [F.date_format(F.to_utc_timestamp("created_at", F.current_timezone()), "yyyyMMdd").alias("date_key"), "user_id", F.col("a.name").alias("name"), F.col("a.os_name").alias("os_name"), F.col("a.device").alias("device"), (s - s % 3600).alias("time_key")]
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
