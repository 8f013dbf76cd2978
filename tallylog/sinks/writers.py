"""Results as text.

Rows go out in record order. Small results (groups, patterns, comparisons) are formatted by the driver; rows are streamed through it one partition at a time
(``write_rows``), or written by the executors (``save_rows``).
"""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.changes import format_change
from ..operators.diff import THRESHOLD, Comparison, section
from ..operators.rows import in_order

# The formats, by name.
FORMATS = {"": "raw", "raw": "raw", "json": "json", "csv": "csv"}


def parse_format(name: str) -> str:
    if name not in FORMATS:
        raise ValueError(f"unknown format: {name!r} (use raw, json, or csv)")
    return FORMATS[name]


def fields_json() -> Column:
    """A record's fields as one JSON object: all text, keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields"))))


def csv_columns(records: DataFrame) -> list[str]:
    """All field names of the records, sorted: aggregated on the executors, and as few as names are."""
    return sorted(r[0] for r in records.select(F.explode(F.map_keys("fields"))).distinct().collect())


def _csv(out: TextIO):
    return csv.writer(out, lineterminator="\n")


def write_rows(records: DataFrame, out: TextIO, kind: str = "raw", columns: Sequence[str] | None = None) -> int:
    """Rows in order; how many. ``columns`` are for CSV. CSV of no rows is nothing, not even a header."""
    ordered, n = in_order(records), 0
    if kind == "csv":
        names = list(columns or csv_columns(records))
        writer = _csv(out)
        for row in ordered.select(*[F.coalesce(F.col("fields")[c], F.lit("")) for c in names]).toLocalIterator(prefetchPartitions=True):
            if not n:
                writer.writerow(names)
            writer.writerow(list(row))
            n += 1
        return n
    for row in ordered.select((fields_json() if kind == "json" else F.col("raw")).alias("line")).toLocalIterator(prefetchPartitions=True):
        out.write(row["line"] + "\n")
        n += 1
    return n


def save_rows(records: DataFrame, path: str, kind: str = "raw", columns: Sequence[str] | None = None) -> None:
    """Rows as a folder of text files whose names follow the order, by as many tasks as there are partitions."""
    if kind == "csv":
        names = list(columns or csv_columns(records))
        quoted = [F.coalesce(F.col("fields")[c], F.lit("")) for c in names]
        quoted = [F.when(v.rlike('[",\\r\\n]|^ '), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v) for v in quoted]
        line = F.concat_ws(",", *quoted)
    else:
        line = fields_json() if kind == "json" else F.col("raw")
    in_order(records).select(line.alias("value")).write.text(path)


def _table(pairs: list[tuple[str, int]], out: TextIO) -> None:
    if pairs:
        width = max(5, *(len(v.encode()) for v, _ in pairs))
        for value, n in [("VALUE", "COUNT"), *pairs]:
            out.write(f"{value:<{width}}  {n}\n")


def _write_counts(rows: DataFrame, name: str, out: TextIO, kind: str, table) -> None:
    pairs = [(r[name], r["count"]) for r in rows.collect()]
    if kind == "json":
        out.write(json.dumps([{name: v, "count": n} for v, n in pairs], indent=2, ensure_ascii=False) + "\n")
    elif kind == "csv":
        _csv(out).writerows([(name, "count"), *pairs])
    else:
        table(pairs, out)


def write_groups(groups: DataFrame, out: TextIO, kind: str = "raw") -> None:
    """(value, count) rows as a table, JSON or CSV."""
    _write_counts(groups, "value", out, kind, _table)


def write_patterns(patterns: DataFrame, out: TextIO, kind: str = "raw") -> None:
    """(template, count) rows as a table, JSON or CSV."""

    def table(pairs, out):
        if pairs:
            out.write("".join(f"{n:>6}  {v}\n" for v, n in [("TEMPLATE", "COUNT"), *pairs]))

    _write_counts(patterns, "template", out, kind, table)


def diff_document(c: Comparison, left: str, right: str, top: int = 0, threshold: float = THRESHOLD) -> dict:
    """A comparison as a JSON document; counts of nothing are left out of patterns."""
    s = c.summary.first()

    def patterns(kind: str) -> list[dict]:
        out = []
        for r in section(c, kind, top, threshold).collect():
            row = {"template": r["template"], "left": r["left"], "right": r["right"]} | ({"change": format_change(r["left"], r["right"])} if kind == "changed" else {})
            out.append({k: v for k, v in row.items() if v})
        return out

    return {
        "left": {"name": left, "records": s["left_count"], "patterns": s["left_patterns"]},
        "right": {"name": right, "records": s["right_count"], "patterns": s["right_patterns"]},
        "levels": [{"level": r["level"], "left": r["left"], "right": r["right"], "change": format_change(r["left"], r["right"])} for r in c.levels.collect()],
        "new_patterns": patterns("new"), "gone_patterns": patterns("gone"), "changed_patterns": patterns("changed"),
    }


def write_diff(c: Comparison, out: TextIO, left: str, right: str, kind: str = "table", top: int = 0, threshold: float = THRESHOLD) -> None:
    """A comparison as a table or JSON. ``top`` shortens the lists, not the numbers in their titles."""
    if kind == "json":
        out.write(json.dumps(diff_document(c, left, right, top, threshold), indent=2, ensure_ascii=False) + "\n")
        return
    s, line = c.summary.first(), lambda name, a, b, x: f"  {name:<20} {a:>8} {b:>8} {x:>8}\n"
    out.write(f"{left} vs {right}\n\n" + line("", "Before", "After", "Change"))
    for name, key in (("Records", "count"), ("Patterns", "patterns")):
        a, b = s[f"left_{key}"], s[f"right_{key}"]
        out.write(line(name, a, b, format_change(a, b)))
    out.write("\n")
    if levels := c.levels.collect():
        out.write("  Level Distribution\n" + line("Level", "Before", "After", "Change"))
        out.write("".join(line(r["level"], r["left"], r["right"], format_change(r["left"], r["right"])) for r in levels) + "\n")
    for kind_, title, side, place in (("new", "New", "right", right), ("gone", "Gone", "left", left)):
        rows = section(c, kind_, top).collect()
        total = c.patterns.where(F.col("kind") == kind_).count()
        out.write(f"  {title} Patterns ({total} only in {place})\n" + ("".join(f"  {r[side]:>6}  {r['template']}\n" for r in rows) or "    (none)\n") + "\n")
    rows = section(c, "changed", top, threshold).collect()
    out.write(f"  Changed Patterns (>{threshold:.0f}% change)\n")
    if not rows:
        out.write("    (none)\n")
        return
    out.write(f"  {'Before':>8} {'After':>8} {'Change':>8}  Template\n")
    out.write("".join(f"  {r['left']:>8} {r['right']:>8} {format_change(r['left'], r['right']):>8}  {r['template']}\n" for r in rows))
