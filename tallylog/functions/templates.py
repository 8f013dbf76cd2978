"""Messages without what varies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX = "[0-9a-fA-F]"
# Where an ASCII word begins, before a digit or a hex digit, and where it ends; the cheap test comes first.
_DIGIT, _HEX_DIGIT = "(?=[0-9])(?<![0-9A-Za-z_])", f"(?={_HEX})(?<![0-9A-Za-z_])"
_END = "(?![0-9A-Za-z_])"

# What varies and what stands for it, in this order.
PLACEHOLDERS = (
    (f"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}", "<uuid>"),
    (rf"{_DIGIT}[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}{_END}", "<ip>"),
    (f"{_HEX_DIGIT}{_HEX}{{16,}}{_END}", "<hex>"),
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?", "<timestamp>"),
    ("(/[a-zA-Z0-9._-]+){2,}", "<path>"),
    (rf"{_DIGIT}[0-9]+(\.[0-9]+)?(ms|ns|us|µs|s|m|h){_END}", "<duration>"),
    (rf"{_DIGIT}[0-9]+(\.[0-9]+)?{_END}", "<num>"),
)
#: Without any of this there is nothing to replace.
VARYING = f"[0-9/]|{_HEX}{{16}}"


def templatize(text: Column) -> Column:
    out = text
    for pattern, placeholder in PLACEHOLDERS:
        out = F.regexp_replace(out, pattern, placeholder)
    return F.when(text.rlike(VARYING), out).otherwise(text)
