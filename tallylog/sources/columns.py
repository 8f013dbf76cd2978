"""Records from tables that have columns already."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import normalize_level
from ..plans.compiler import PROMOTED, TIME


def records_from_columns(df: DataFrame, ts: Column, level: Column, message: Column, fields: Mapping[str, Column], line_number: Column | None = None, source: Column | None = None) -> DataFrame:
    """Records whose parts are columns: ``ts`` a timestamp, ``level`` as written, ``fields`` by name. Null fields are left out; ``raw`` is the fields as JSON. Nothing is parsed, and each
    field keeps a column of its own beside the map (as ``promote`` gives it), as does a timestamp without a zone: filters on these reach the scan, and what isn't used is pruned."""
    both = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()])
    entries = F.map_from_entries(F.filter(both, lambda e: e["value"].isNotNull()))
    zoneless = ts is not None and df.select(ts).dtypes[0][1] == "timestamp_ntz"
    micros = F.unix_micros(ts.cast("timestamp")) if ts is not None else F.lit(None).cast("long")
    return df.select(
        (source if source is not None else F.lit(None).cast("string")).alias("source"),
        (line_number if line_number is not None else F.lit(None)).cast("long").alias("line_number"),
        micros.alias("ts_us"), F.coalesce(normalize_level(level), F.lit("")).alias("level"), F.coalesce(message, F.lit("")).alias("message"),
        entries.alias("fields"), F.to_json(entries).alias("raw"), *[v.cast("string").alias(PROMOTED + k) for k, v in fields.items()], *([ts.alias(TIME)] if zoneless else []))
