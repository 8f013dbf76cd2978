"""Where a query's words are in a text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import language as q
from ..plans.regex import BadPattern, to_java

# Names that are the message's as well.
MESSAGE_NAMES = frozenset({"message", "msg", "body", "text"})


@dataclass(frozen=True)
class Term:
    """A text, or a pattern; ``field`` is empty for all fields."""

    text: str = ""
    pattern: str = ""
    field: str = ""


def terms_of(node: q.Node) -> list[Term]:
    """What a query looks for: words, values and patterns, but not what it excludes or compares."""
    match node:
        case q.FullText(text):
            return [Term(text)]
        case q.FieldMatch(field, value):
            return [Term(value, field=field)]
        case q.FieldRegex(field, pattern):
            try:
                to_java(pattern)
                re.compile(pattern, re.I)
            except (BadPattern, re.error):
                return []
            return [Term(pattern=pattern, field=field)]
        case q.And(left, right) | q.Or(left, right):
            return terms_of(left) + terms_of(right)
    return []


def ranges_in(text: str, terms: list[Term], field: str) -> list[tuple[int, int]]:
    """[start, end) of matches in a field's text, in either case, in order; those that overlap or touch are one."""
    found = []
    for t in terms:
        if t.field and t.field != field and not {t.field, field} <= MESSAGE_NAMES:
            continue
        if t.pattern or t.text:
            found += [m.span() for m in re.finditer(t.pattern or re.escape(t.text), text, re.I)]
    merged: list[tuple[int, int]] = []
    for start, end in sorted(found, key=lambda r: r[0]):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def match_ranges(query: str, field: str, text: Column) -> Column:
    """array<struct<start,end>> of a query's matches in a column that shows ``field``."""
    terms = terms_of(q.parse(query))

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [{"start": a, "end": b} for a, b in ranges_in(t or "", terms, field)])

    return run(text)
