"""Counts by a field's value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import field_of

# Fixed value: what stands for no value.
NO_VALUE = "(empty)"


def group_counts(records: DataFrame, field: str, top: int = 0) -> DataFrame:
    """(value, count), most frequent first, ties by value; the first ``top`` if that is above 0. Counts are summed before the exchange, so a frequent value is no burden."""
    value = F.coalesce(F.nullif(field_of(records, field), F.lit("")), F.lit(NO_VALUE))
    found = records.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value")
    return found.limit(top) if top > 0 else found


def level_counts(records: DataFrame) -> DataFrame:
    """(level, count) of records that have a level."""
    return records.where("level != ''").groupBy("level").agg(F.count(F.lit(1)).alias("count"))
