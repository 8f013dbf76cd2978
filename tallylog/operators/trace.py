"""Requests followed by their identifiers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import is_hex_id, is_uuid, name_of, normalize_name
from ..plans.compiler import field_of

# The names of identifiers that are known without configuration.
ID_NAMES = ("trace_id", "request_id", "correlation_id", "span_id", "x_request_id")


def detect_ids(records: DataFrame, names: Iterable[str] = ID_NAMES) -> DataFrame:
    """``records`` with ``ids``: (name, value, by_name) of fields that have a known name, then of those whose value looks like an identifier, each by name."""
    known = [name_of(n) for n in names]
    entries = F.transform(F.filter(F.map_entries("fields"), lambda e: e["value"] != ""), lambda e: F.struct(
        (~normalize_name(e["key"]).isin(*known)).alias("rest") if known else F.lit(True).alias("rest"), e["key"].alias("name"), e["value"].alias("value")))
    kept = F.array_sort(F.filter(entries, lambda e: ~e["rest"] | is_uuid(e["value"]) | is_hex_id(e["value"])))
    return records.withColumn("ids", F.transform(kept, lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value"), (~e["rest"]).alias("by_name"))))


def build_query(field: str, value: str) -> str:
    """The query for a field's value, quoted unless it is all letters, digits, dashes, underscores and dots."""
    plain = all(c.isalpha() or c.isdecimal() or c in "-_." for c in value)
    return f"{field}:{value}" if plain else f'{field}:"{value}"'


def follow_traces(records: DataFrame, values: DataFrame, field: str) -> DataFrame:
    """Records of any of many traces: ``values`` has a column ``value``. One semi-join, whatever the number of traces."""
    wanted = values.select(F.col("value").alias("_trace")).distinct()
    return records.join(wanted, field_of(records, field) == F.col("_trace"), "left_semi")
