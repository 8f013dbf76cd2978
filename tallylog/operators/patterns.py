"""Messages of one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.templates import templatize


def template() -> Column:
    """The template of a record: of its message, or of its raw text if it has none."""
    return templatize(F.coalesce(F.nullif(F.col("message"), F.lit("")), F.col("raw")))


def pattern_counts(records: DataFrame, top: int = 0, share: bool = False) -> DataFrame:
    """(template, count), most frequent first, ties by template; with ``share``, also its per cent of all matches."""
    found = records.groupBy(template().alias("template")).agg(F.count(F.lit(1)).alias("count"))
    if share:
        total = records.agg(F.count(F.lit(1)).alias("total"))
        found = found.join(F.broadcast(total), F.lit(True)).select("template", "count", (100.0 * F.col("count") / F.col("total")).alias("share"))
    found = found.orderBy(F.desc("count"), "template")
    return found.limit(top) if top > 0 else found


def of_pattern(records: DataFrame, wanted: str) -> DataFrame:
    """The records of a template."""
    return records.where(template() == F.lit(wanted))
