"""Two sets of records beside each other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.changes import change_percent
from .patterns import template

# The levels compared, in this order.
LEVELS = ("fatal", "error", "warn", "info", "debug")
THRESHOLD = 50.0


@dataclass
class Comparison:
    """``patterns`` (kind, template, left, right, percent), ``levels`` (level, left, right) and ``summary`` (one row)."""

    patterns: DataFrame
    levels: DataFrame
    summary: DataFrame


def _sides(left: DataFrame, right: DataFrame, *columns) -> DataFrame:
    return left.select(*columns, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*columns, F.lit(0).alias("l"), F.lit(1).alias("r")))


def compare(left: DataFrame, right: DataFrame) -> Comparison:
    """Counts of both sides in one pass and one exchange of partial sums: a full outer join of two aggregates, without the join."""
    sides = _sides(left, right, template().alias("template"))
    counts = sides.groupBy("template").agg(F.sum("l").alias("left"), F.sum("r").alias("right"))
    kind = F.when(F.col("left") == 0, "new").when(F.col("right") == 0, "gone").otherwise("changed")
    patterns = counts.select(kind.alias("kind"), "template", "left", "right", change_percent(F.col("left"), F.col("right")).alias("percent"))
    place = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    levels = _sides(left, right, "level").where(F.col("level").isin(*LEVELS)).groupBy("level").agg(F.sum("l").alias("left"), F.sum("r").alias("right")).orderBy(place)
    summary = counts.agg(
        F.coalesce(F.sum("left"), F.lit(0)).alias("left_count"), F.coalesce(F.sum("right"), F.lit(0)).alias("right_count"),
        F.count_if(F.col("left") > 0).alias("left_patterns"), F.count_if(F.col("right") > 0).alias("right_patterns"))
    return Comparison(patterns, levels, summary)


def section(comparison: Comparison, kind: str, top: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """The ``new``, ``gone`` or ``changed`` patterns in the order they are shown; changed ones of at least the threshold."""
    found = comparison.patterns.where(F.col("kind") == kind)
    if kind == "changed":
        found = found.where(F.abs("percent") >= threshold).orderBy(F.abs("percent").desc(), "template")
    else:
        found = found.orderBy(F.desc("right" if kind == "new" else "left"), "template")
    return found.limit(top) if top > 0 else found
