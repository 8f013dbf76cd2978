"""How much a count has changed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def change_percent(before: Column, after: Column) -> Column:
    """In per cent of ``before``; from nothing to something is 100."""
    return F.when(before == 0, F.when(after == 0, 0.0).otherwise(100.0)).otherwise((after - before) * 1.0 / before * 100.0)


def percent_of(before: int, after: int) -> float:
    if before == 0:
        return 0.0 if after == 0 else 100.0
    return (after - before) / before * 100


def format_change(before: int, after: int) -> str:
    """As ``+12%``, ``-3%``, ``0%``, ``new``, or ``-`` for nothing on either side; halves go to even."""
    if before == 0:
        return "-" if after == 0 else "new"
    if before == after:
        return "0%"
    change = percent_of(before, after)
    return f"+{change:.0f}%" if change > 0 else f"{change:.0f}%"


def format_size(size: int) -> str:
    """Bytes as 12B, 1.5KB, 2.0MB or 3.1GB."""
    for unit, name in ((1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB")):
        if size >= unit:
            return f"{size / unit:.1f}{name}"
    return f"{size}B"
