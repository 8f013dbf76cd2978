"""Times in text, as microseconds since the epoch. Layouts are strict; without a zone it is UTC, without a year the year 0."""

from __future__ import annotations

import re

from .numbers import parse_double

_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_MON, _DAY = "(?P<mon>[A-Za-z]{3})", "(?:Sun|Mon|Tue|Wed|Thu|Fri|Sat)"
_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d\d):(?P<s>\d\d)(?:[.,](?P<f>\d+))?"
_YMD = r"(?P<y>\d{4})-(?P<mo>\d\d)-(?P<d>\d\d)"
_ZONE = r"(?:Z|(?P<zh>[+-]\d\d):(?P<zm>\d\d))"
_SHORT = r"(?P<zh>[+-]\d\d)(?P<zm>\d\d)"

RFC3339 = re.compile(f"{_YMD}T{_CLOCK}{_ZONE}", re.ASCII)
SPACED = re.compile(f"{_YMD} {_CLOCK}", re.ASCII)
NAIVE = re.compile(f"{_YMD}T{_CLOCK}", re.ASCII)
ACCESS_LOG = re.compile(rf"(?P<d>\d\d)/{_MON}/(?P<y>\d{{4}}):{_CLOCK} {_SHORT}", re.ASCII)
UNIX_DATE = re.compile(rf"(?i:{_DAY}) {_MON} {{1,2}}(?P<d>\d{{1,2}}) {_CLOCK} (?:[A-Z]{{3,5}}) (?P<y>\d{{4}})", re.ASCII)
RUBY_DATE = re.compile(rf"(?i:{_DAY}) {_MON} (?P<d>\d\d) {_CLOCK} {_SHORT} (?P<y>\d{{4}})", re.ASCII)
SYSLOG = re.compile(rf"{_MON} {{1,2}}(?P<d>\d{{1,2}}) {_CLOCK}", re.ASCII)
SLASHED = re.compile(rf"(?P<y>\d{{4}})/(?P<mo>\d\d)/(?P<d>\d\d) {_CLOCK}", re.ASCII)
CLOCK_ONLY = re.compile(_CLOCK, re.ASCII)

#: For fields, in this order.
FIELD_LAYOUTS = (RFC3339, SPACED, NAIVE, ACCESS_LOG, UNIX_DATE, RUBY_DATE, SYSLOG, SLASHED)


def _days(y: int, m: int, d: int) -> int:
    """Days since the epoch, in the proleptic Gregorian calendar, also for the year 0."""
    y -= m <= 2
    era, yoe = y // 400, y % 400
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def _month_days(y: int, m: int) -> int:
    return (29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28) if m == 2 else 30 if m in (4, 6, 9, 11) else 31


def micros(layout: re.Pattern, text: str) -> int | None:
    """The time that a text of this layout names, or None."""
    if not (m := layout.fullmatch(text)):
        return None
    g = m.groupdict()
    year = int(g.get("y") or 0)
    month = _MONTHS.get(g["mon"].lower(), 0) if g.get("mon") else int(g.get("mo") or 1)
    day, hour, minute, second = int(g.get("d") or 1), int(g["h"]), int(g["mi"]), int(g["s"])
    if not (1 <= month <= 12 and 1 <= day <= _month_days(year, month) and hour < 24 and minute < 60 and second < 60):
        return None
    offset = 0
    if g.get("zh"):
        if abs(int(g["zh"])) > 24 or int(g["zm"]) > 59:
            return None
        offset = (abs(int(g["zh"])) * 60 + int(g["zm"])) * (-60 if g["zh"][0] == "-" else 60)
    seconds = _days(year, month, day) * 86400 + hour * 3600 + minute * 60 + second - offset
    return seconds * 1_000_000 + int(((g["f"] or "") + "000000")[:6])


def parse_timestamp(text: str) -> int | None:
    """A field's time: one of the layouts, or seconds (above 1e9) or milliseconds (above 1e12) since the epoch, up to the year 294,247."""
    text = text.strip()
    for layout in FIELD_LAYOUTS:
        if (found := micros(layout, text)) is not None:
            return found
    number = parse_double(text)
    if number is None or not 1e9 < number < 1e18:
        return None
    whole = int(number / 1000) if number > 1e12 else int(number)
    rest = (number - whole * 1000) / 1000 if number > 1e12 else number - whole
    found = whole * 1_000_000 + int(rest * 1_000_000_000) // 1000
    return found if found < 1 << 63 else None
