"""One entry's text as a record: JSON, key=value pairs, or plain text."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..functions import timestamps as t
from ..functions.levels import level_of
from .jsontext import flatten, strict_loads

# The fields that may hold the time, the level and the message, in this order.
TIME_KEYS = ("timestamp", "ts", "time", "@timestamp", "datetime", "t", "date")
LEVEL_KEYS = ("level", "lvl", "severity", "loglevel")
MESSAGE_KEYS = ("message", "msg", "body", "text")
# Short names in key=value text, and the names they stand in for.
SHORT_NAMES = {"msg": "message", "ts": "timestamp", "lvl": "level"}

# How times begin a plain line, and the layouts of each.
LEADING_TIMES = (
    (re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", re.ASCII), (t.RFC3339, t.NAIVE, t.SPACED)),
    (re.compile(r"\d{1,2}:\d{2}:\d{2}(?:\.\d+)?", re.ASCII), (t.CLOCK_ONLY,)),
    (re.compile(r"[A-Z][a-z]{2}[\t\n\f\r ]+\d{1,2}[\t\n\f\r ]+\d{2}:\d{2}:\d{2}", re.ASCII), (t.SYSLOG,)),
    (re.compile(r"\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}[\t\n\f\r ]+[+-]\d{4}", re.ASCII), (t.ACCESS_LOG,)),
)
# Level words in plain text.
LEVEL_WORD = re.compile(r"(?:\A|[\t\n\f\r \[(])(DEBUG|INFO|INFORMATION|WARN|WARNING|ERROR|ERR|FATAL|CRITICAL|PANIC)(?=[\t\n\f\r \]):]|\Z)", re.I)
LEVEL_BYTES, SHORT_LINE, LOOK_AHEAD = 200, 60, 5

_PAIR = re.compile(r'[ \t]*(?:([^= \t]*)=(?:"((?:\\.|[^"\\]|\\\Z)*)"?|([^ \t]*)))', re.S)


class Record(NamedTuple):
    ts_us: int | None
    level: str
    message: str
    fields: dict[str, str]
    raw: str


def _with_envelope(fields: dict[str, str], raw: str) -> Record:
    def first(keys):
        return next((fields[k] for k in keys if fields.get(k)), "")

    times = (t.parse_timestamp(fields[k]) for k in TIME_KEYS if fields.get(k))
    level = first(LEVEL_KEYS)
    return Record(next((x for x in times if x is not None), None), level_of(level) if level else "", first(MESSAGE_KEYS), fields, raw)


def parse_pairs(text: str) -> dict[str, str] | None:
    """Fields of key=value text, two at least, up to the first word without ``=``; None if it isn't such text. Quoted values keep their backslashes."""
    fields, n, pos = {}, 0, 0
    while m := _PAIR.match(text, pos):
        if m[1]:
            fields[m[1]] = m[2] if m[2] is not None else m[3]
            n += 1
        pos = m.end()
    if n < 2:
        return None
    for short, name in SHORT_NAMES.items():
        if short in fields:
            fields.setdefault(name, fields[short])
    return fields


def _message(first: str, rest: str, timed: bool) -> str:
    """The first line, or what follows it where that is little more than a time."""
    if rest and timed and len(first.strip().encode()) < SHORT_LINE:
        for piece in rest.split("\n", LOOK_AHEAD - 1):
            piece = piece.strip()
            if piece and piece != "---" and not piece.startswith("----"):
                return piece
    return first


def parse_plain(text: str) -> Record:
    first, _, rest = text.partition("\n")
    fields, ts = {}, None
    for shape, layouts in LEADING_TIMES:
        if m := shape.match(first.strip()):
            ts = next((x for layout in layouts if (x := t.micros(layout, m[0])) is not None), None)
            if ts is not None:
                fields["timestamp"] = m[0]
                break
    message = fields["message"] = _message(first, rest, ts is not None)
    m = LEVEL_WORD.search(text.strip().encode()[:LEVEL_BYTES].decode("utf-8", "replace"))
    level = level_of(m[1]) if m else ""
    if m:
        fields["level"] = level
    return Record(ts, level, message, fields, text)


def parse_entry(text: str) -> Record:
    """The record of an entry. What looks like JSON or pairs but isn't is plain text."""
    bare = text.strip()
    if not bare:
        return Record(None, "", "", {}, text)
    if bare[0] == "{":
        try:
            return _with_envelope(flatten(strict_loads(bare)), bare)
        except (ValueError, RecursionError):
            pass
    if "=" in bare and (fields := parse_pairs(bare)) is not None:
        return _with_envelope(fields, bare)
    return parse_plain(text)
