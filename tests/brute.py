"""Plain Python versions of operators, one value or group at a time, to hold results against."""

import datetime as dt
import re
from zoneinfo import ZoneInfo

EPOCH = dt.datetime(1970, 1, 1)
SHORT = "jan feb mar apr may jun jul aug sep oct nov dec".split()
ABBR = {"GMT": 0, "UTC": 0, "Z": 0, "CET": 1, "CEST": 2, "EST": -5, "EDT": -4, "PST": -8, "PDT": -7}


def micros(d):
    return (d - EPOCH) // dt.timedelta(microseconds=1)


def instants(wall, zone):
    z = ZoneInfo(zone)
    out = set()
    for fold in (0, 1):
        u = wall.replace(tzinfo=z, fold=fold).astimezone(dt.timezone.utc)
        if u.astimezone(z).replace(tzinfo=None) == wall:
            out.add(u.replace(tzinfo=None))
    return sorted(out)


def read_time(v, zone=None):
    """(readable, microseconds or None) of one value."""
    if v is None or not v.strip():
        return False, None
    v = v.strip()
    if re.fullmatch(r"\d{10}(\.\d+)?|\d{13}|\d{16}|\d{19}", v):
        whole, _, frac = v.partition(".")
        n = len(whole)
        return True, int(whole) * 10**6 + int((frac + "000000")[:6]) if n == 10 else int(whole) * 1000 if n == 13 else int(whole) if n == 16 else int(whole) // 1000
    m = re.match(r"(\d{4})[-/](\d\d)[-/](\d\d)[T ](.*)$", v)
    if m:
        y, mo, d, rest = int(m[1]), int(m[2]), int(m[3]), m[4]
    elif m := re.match(r"(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)(.*)$", v):
        y, mo, d, rest = int(m[1]), int(m[2]), int(m[3]), f"{m[4]}:{m[5]}:{m[6]}{m[7]}"
    elif m := re.match(r"(\d\d)/(\w{3})/(\d{4}):(.*)$", v):
        y, mo, d, rest = int(m[3]), m[2], int(m[1]), m[4]
    elif m := re.match(r"(?:\w{3}, )?(\d{1,2}) ([A-Za-z]+) (\d{4}) (.*)$", v):
        y, mo, d, rest = int(m[3]), m[2], int(m[1]), m[4]
    elif m := re.match(r"([A-Za-z]+) (\d{1,2}), (\d{4}) (.*)$", v):
        y, mo, d, rest = int(m[3]), m[1], int(m[2]), m[4]
    else:
        return False, None
    if isinstance(mo, str):
        if mo.lower()[:3] not in SHORT:
            return False, None
        mo = SHORT.index(mo.lower()[:3]) + 1
    m = re.match(r"(\d{1,2}):(\d\d)(?::(\d\d)(?:\.(\d+))?)?(?: (AM|PM))?\s*(.*)$", rest)
    if not m:
        return False, None
    h, mi, s, frac, ap, tail = int(m[1]), int(m[2]), int(m[3] or 0), int(((m[4] or "") + "000000")[:6]), m[5], m[6]
    if ap:
        if not 1 <= h <= 12:
            return False, None
        h = h % 12 + 12 * (ap == "PM")
    try:
        wall = dt.datetime(y, mo, d, h, mi, s, frac)
    except ValueError:
        return False, None
    if t := re.fullmatch(r"([+-])(\d\d):?(\d\d)?(?:\[.*\])?", tail):
        shift = dt.timedelta(hours=int(t[2]), minutes=int(t[3] or 0))
        return True, micros(wall - shift if t[1] == "+" else wall + shift)
    if tail in ABBR:
        return True, micros(wall - dt.timedelta(hours=ABBR[tail]))
    if "/" in tail:
        zone = tail
    elif tail:
        return False, None
    if zone is None:
        return True, None
    got = instants(wall, zone)
    return True, micros(got[0]) if len(got) == 1 else None
