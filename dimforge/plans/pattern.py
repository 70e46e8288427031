"""Time patterns of paths and tables: strftime tokens to a matcher, a renderer and a step."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from dataclasses import dataclass
from functools import cached_property
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens, what they match, and what they name. `%s` and its forms are epoch seconds,
# stepped by the unit the form names.
TOKENS = {
    "%H-s": (r"\d{10}", "stamp"), "%d-s": (r"\d{10}", "stamp"), "%m-s": (r"\d{10}", "stamp"), "%Y-s": (r"\d{10}", "stamp"), "%s": (r"\d{10}", "stamp"),
    "%Y": (r"\d{4}", "year"), "%-m": (r"\d{1,2}", "month"), "%m": (r"\d{2}", "month"), "%-d": (r"\d{1,2}", "day"), "%d": (r"\d{2}", "day"),
    "%-H": (r"\d{1,2}", "hour"), "%H": (r"\d{2}", "hour"), "%-k": (r"\d{1,2}", "hour"), "%k": (r"[ \d]\d", "hour"),
}
_SPLIT = re.compile(r"(%[HdmY]-s|%s|%-?[mdHk]|%Y|\*)")
STEPS = ("hour", "day", "month", "year")


def cut(t: dt.datetime, step: str) -> dt.datetime:
    """`t` at the beginning of its hour, day, month or year."""
    t = t.replace(minute=0, second=0, microsecond=0)
    if step != "hour":
        t = t.replace(hour=0)
    if step in ("month", "year"):
        t = t.replace(day=1)
    return t.replace(month=1) if step == "year" else t


def move(t: dt.datetime, step: str, n: int = 1) -> dt.datetime:
    """`n` steps later; a month's last day stays within the month it comes to."""
    if step in ("hour", "day"):
        return t + n * dt.timedelta(**{f"{step}s": 1})
    months = t.year * 12 + t.month - 1 + n * (12 if step == "year" else 1)
    year, month = divmod(months, 12)
    return t.replace(year=year, month=month + 1, day=min(t.day, calendar.monthrange(year, month + 1)[1]))


@dataclass(frozen=True)
class Pattern:
    """A template such as /log/%Y/%m/%d or visits_y%Ym%m; `*` matches anything."""

    text: str
    zone: str = "UTC"

    @cached_property
    def parts(self) -> list[str]:
        return [p for p in _SPLIT.split(self.text) if p]

    @property
    def free(self) -> bool:
        return "%" in self.text or "*" in self.text

    @cached_property
    def step(self) -> str:
        """The finest unit the tokens name; a plain timestamp is hourly, and so is a pattern without any."""
        forms = {"%s": "hour", "%H-s": "hour", "%d-s": "day", "%m-s": "month", "%Y-s": "year"}
        for form, step in forms.items():
            if form in self.parts:
                return step
        units = {TOKENS[p][1] for p in self.parts if p in TOKENS}
        return next((u for u in STEPS if u in units), "hour")

    @cached_property
    def names(self) -> list[str]:
        """What the groups of :attr:`regex` are, in order."""
        return ["glob" if p == "*" else TOKENS[p][1] for p in self.parts if p == "*" or p in TOKENS] + ["rest"]

    @cached_property
    def regex(self) -> str:
        """Unnamed groups, so that Java's and Python's engines both take it; a wildcard at the end takes the rest."""
        last = len(self.parts) - 1
        return "^" + "".join(("(.*)" if i == last else "(.*?)") if p == "*" else f"({TOKENS[p][0]})" if p in TOKENS else re.escape(p).replace(r"\-", "-") for i, p in enumerate(self.parts)) + "(.*)$"

    @cached_property
    def _compiled(self) -> re.Pattern:
        return re.compile(self.regex, re.S)

    def match(self, text: str) -> dict[str, str] | None:
        """Parts of `text` by name; a repeated unit counts as it is last written. None if it doesn't match."""
        m = self._compiled.match(text)
        return dict(zip(self.names, m.groups())) if m else None

    def matches(self, text: str) -> bool:
        """Whether `text` is an instance: nothing, or another wildcard, may follow the pattern."""
        got = self.match(text)
        return got is not None and (not got["rest"] or "*" in got["rest"])

    def covers(self, text: str) -> bool:
        """Whether `text` is an instance or lies in the folder of one."""
        got = self.match(text)
        return got is not None and (not got["rest"] or "*" in got["rest"] or got["rest"].startswith("/"))

    @cached_property
    def root(self) -> str:
        """The folder all instances are below; empty for tables."""
        return "/".join(re.split(r"[%*]", self.text, maxsplit=1)[0].split("/")[:-1]) if "/" in self.text else ""

    def time(self, text: str) -> dt.datetime:
        got = self.match(text)
        if got is None:
            raise ValueError(f"{text} is no instance of {self.text}")
        if "stamp" in got:
            return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=int(got["stamp"]))
        return dt.datetime(*(int(got.get(u, d)) for u, d in (("year", 1), ("month", 1), ("day", 1), ("hour", 0))))

    def render(self, t: dt.datetime, glob: str | None = None) -> str:
        """The instance at `t` (cut to the step); the first `*` is replaced by `glob` if that is given."""
        out = []
        for p in self.parts:
            if p == "*":
                out.append(glob or "*")
                glob = None
            elif p not in TOKENS:
                out.append(p)
            else:
                unit = TOKENS[p][1]
                n = calendar.timegm(t.timetuple()) if unit == "stamp" else getattr(t, unit)
                width = {"%Y": 4, "%m": 2, "%d": 2, "%H": 2}.get(p, 0)
                out.append(f"{n:2d}" if p == "%k" else f"{n:0{width}d}")
        return "".join(out)

    def local(self, t: dt.datetime) -> dt.datetime:
        """UTC `t` on the clocks of the pattern's zone."""
        return t.replace(tzinfo=dt.timezone.utc).astimezone(ZoneInfo(self.zone)).replace(tzinfo=None)

    def rounded(self, grain: str) -> Pattern:
        """The pattern up to the first path part that has the grain's token."""
        token = {"hour": r"%-?[Hk]", "day": r"%-?d", "month": r"%-?m", "year": r"%Y"}[grain]
        parts = self.text.split("/")
        at = next((i for i, p in enumerate(parts) if re.search(token, p)), None)
        if at is None:
            raise ValueError(f"{self.text} can't be rounded to {grain}")
        return Pattern("/".join(parts[: at + 1]), self.zone)

    def time_column(self, path: Column, below: bool = False) -> Column:
        """The time of each instance in `path` (with `below`, of what is in the folder of one), null where it is none; in the JVM."""
        units = {n: i + 1 for i, n in enumerate(self.names)}
        part = lambda n, d: F.trim(F.regexp_extract(path, self.regex, units[n])).try_cast("int") if n in units else F.lit(d)
        if "stamp" in units:
            made = F.to_timestamp_ntz(F.timestamp_seconds(F.regexp_extract(path, self.regex, units["stamp"]).try_cast("long")).cast("string"))
        else:
            made = F.try_make_timestamp_ntz(part("year", 1), part("month", 1), part("day", 1), part("hour", 0), F.lit(0), F.lit(0))
        rest = F.regexp_extract(path, self.regex, units["rest"])
        ends = (rest == "") | rest.contains("*")
        return F.when(path.rlike(self.regex) & (ends | rest.startswith("/") if below else ends), made)
