"""Query trees as Spark conditions.

Every leaf is true or false, never null: a record without the field doesn't match, and neither does any record for a literal or a pattern that can't be read, so
that NOT of such a leaf holds for all.
"""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_double, strict_double
from ..functions.text import contains_ci
from ..functions.timestamps import parse_timestamp
from . import language as q
from .aliases import Aliases
from .regex import BadPattern, to_java

#: A field with a column of its own is found there: ``promote`` writes it, and Parquet's statistics then serve its filters.
PROMOTED = "f_"
#: Likewise the time, as a timestamp, where a table has one.
TIME = "ts"

_COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def now_micros() -> int:
    return time.time_ns() // 1000


def _two_valued(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def field_of(records: DataFrame, name: str) -> Column:
    """A field's value: its own column where there is one."""
    return F.col(f"`{PROMOTED}{name}`") if PROMOTED + name in records.columns else F.col("fields")[name]


def compile_node(node: q.Node, promoted: Iterable[str] = (), now_us: int | None = None, search_raw: bool = False, for_filter: bool = False, timed: bool = False) -> Column:
    """The condition of a tree over records. ``now_us`` is what ``last:`` counts from, once per query; ``search_raw`` lets words also be found in the raw text.

    ``for_filter``: the condition may be null where it doesn't hold, which a filter takes for false; without the wrapping that makes it false, leaves that aren't below a NOT can be pushed into scans. ``timed``: there is a timestamp column ``ts``, and times are compared with that.
    """
    columns = set(promoted)
    now = now_micros() if now_us is None else now_us

    def field(name: str) -> Column:
        return F.col(f"`{PROMOTED}{name}`") if name in columns else F.col("fields")[name]

    def time_is(op: str, bound: int) -> Column:
        if timed:
            return _COMPARE[op](F.col(TIME), F.timestamp_micros(F.lit(bound)).cast("timestamp_ntz"))
        return _COMPARE[op](F.col("ts_us"), F.lit(bound))

    def walk(n: q.Node, bare: bool) -> Column:
        held = (lambda c: c) if bare else _two_valued
        match n:
            case q.MatchAll():
                return F.lit(True)
            case q.FieldMatch(name, value):
                same = held(field(name) == F.lit(value))
                return same | held((F.col("level") == F.lit(value)) & (F.col("level") != "")) if name == "level" else same
            case q.FieldCompare(name, op, value):
                bound = parse_double(value)
                return F.lit(False) if bound is None else held(_COMPARE[op](strict_double(field(name)), F.lit(bound)))
            case q.TimeCompare(_, op, value):
                bound = parse_timestamp(value)
                return F.lit(False) if bound is None else held(time_is(op, bound))
            case q.RelativeTime(duration):
                return held(time_is(">=", now - q.duration_micros(duration)))
            case q.FieldRegex(name, pattern):
                try:
                    return held(field(name).rlike(to_java(pattern)))
                except BadPattern:
                    return F.lit(False)
            case q.FullText(text):
                found = _two_valued(F.exists(F.map_values("fields"), lambda v: _two_valued(contains_ci(v, text))))
                return found | _two_valued(contains_ci(F.col("raw"), text)) if search_raw else found
            case q.And(left, right):
                return walk(left, bare) & walk(right, bare)
            case q.Or(left, right):
                return walk(left, bare) | walk(right, bare)
            case q.Not(child):
                return ~walk(child, False)
        raise TypeError(n)

    return walk(node, for_filter)


def compile_query(text: str, aliases: Aliases | None = None, **how) -> Column:
    """The condition of a query's text, its aliases expanded first."""
    return compile_node(q.parse((aliases or Aliases()).expand(text)), **how)


def promoted_fields(records: DataFrame) -> list[str]:
    return [c.removeprefix(PROMOTED) for c in records.columns if c.startswith(PROMOTED)]


def promote(records: DataFrame, names: Iterable[str]) -> DataFrame:
    """``records`` with columns of their own for these fields: write that to Parquet, and filters on them are pushed into the scan."""
    return records.withColumns({PROMOTED + n: F.col("fields")[n] for n in names if PROMOTED + n not in records.columns})
