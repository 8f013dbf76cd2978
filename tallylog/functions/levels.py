"""Levels under one name each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words for each level.
WORDS = {
    "debug": ("debug", "dbg", "d", "trace", "trc"),
    "info": ("info", "inf", "i", "information"),
    "warn": ("warn", "warning", "wrn", "w"),
    "error": ("error", "err", "e"),
    "fatal": ("fatal", "ftl", "f", "critical", "crit", "panic", "dpanic"),
}
_OF = {word: level for level, words in WORDS.items() for word in words}


def normalize_level(text: Column) -> Column:
    """debug, info, warn, error or fatal; any other text in lower case, as it is otherwise."""
    levels = F.create_map(*[F.lit(x) for pair in _OF.items() for x in pair])
    return F.coalesce(F.try_element_at(levels, F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))), F.lower(text))


def level_of(text: str) -> str:
    """The same for a Python value."""
    return _OF.get(text.strip().lower(), text.lower())
