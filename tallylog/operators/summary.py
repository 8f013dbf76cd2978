"""What there is to say of a result besides its rows, counted on the way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.changes import format_size
from .histogram import ERRORS
from .rows import matching


class Summary:
    """``total`` and ``matches`` of a query, its ``errors`` and the first and last time (``low``, ``high``) of its matches. Known once its rows have been used by an action; no job of its own runs."""

    def __init__(self) -> None:
        self.all, self.some = Observation(), Observation()

    def get(self) -> dict:
        return {**self.all.get, **self.some.get}


def summarised(records: DataFrame, query: str = "", **how) -> tuple[DataFrame, Summary]:
    """The matching records, and their summary, which is filled in as they are written or collected. ``how``: as for ``matching``."""
    summary = Summary()
    seen = records.observe(summary.all, F.count(F.lit(1)).alias("total"))
    found = matching(seen, query, **how)
    errors = F.count_if(F.col("level").isin(*ERRORS)).alias("errors")
    return found.observe(summary.some, F.count(F.lit(1)).alias("matches"), errors, F.min("ts_us").alias("low"), F.max("ts_us").alias("high")), summary


def size_of(spark: SparkSession, paths: Sequence[str]) -> str:
    """The files' bytes together, as they are shown."""
    conf = spark._jsc.hadoopConfiguration()
    found = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return format_size(sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in found))
