"""Dates as people write them on a command line: ISO, today, yesterday, 3 days ago, 1 month from now, last monday."""

from __future__ import annotations

import datetime as dt
import re

from dimforge.plans.pattern import move

_UNITS = {"hour": "hour", "day": "day", "month": "month", "year": "year"}
_NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def parse(text: str, now: dt.datetime | None = None) -> dt.datetime:
    """The time meant by `text`, seen from `now` (UTC); ValueError if it means none."""
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    t = " ".join(text.strip().lower().split())
    today = now.replace(hour=0, minute=0, second=0, microsecond=0)
    fixed = {"now": now, "today": today, "yesterday": today - dt.timedelta(days=1), "tomorrow": today + dt.timedelta(days=1)}
    if t in fixed:
        return fixed[t]
    if m := re.fullmatch(r"(\d+|[a-z]+) (hour|day|week|month|year)s? (ago|from now)", t):
        n = int(m[1]) if m[1].isdigit() else _NUMBERS.get(m[1])
        if n is not None:
            n *= -1 if m[3] == "ago" else 1
            return now + dt.timedelta(weeks=n) if m[2] == "week" else move(now, _UNITS[m[2]], n)
    if m := re.fullmatch(r"(last|next|this) (hour|day|week|month|year|[a-z]+day)", t):
        sign = {"last": -1, "next": 1, "this": 0}[m[1]]
        if m[2] in _DAYS:
            ahead = (_DAYS.index(m[2]) - today.weekday()) % 7
            return today + dt.timedelta(days=(ahead or 7) if sign > 0 else ahead if sign == 0 else (ahead or 7) - 7 if ahead else -7)
        if m[2] == "week":
            return today + dt.timedelta(weeks=sign)
        if m[2] in _UNITS:
            return move(now, m[2], sign)
    if re.fullmatch(r"\d{8}", t):
        return dt.datetime.strptime(t, "%Y%m%d")
    if re.fullmatch(r"\d{4}-\d{2}", t):
        return dt.datetime.strptime(t, "%Y-%m")
    try:
        got = dt.datetime.fromisoformat(t.upper().replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"expected a date or time, got {text}") from None
    return got.astimezone(dt.timezone.utc).replace(tzinfo=None) if got.tzinfo else got
