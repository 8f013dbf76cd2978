"""Counts over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The levels that count as errors.
ERRORS = ("error", "fatal")


def histogram(records: DataFrame, buckets: int) -> DataFrame:
    """(bucket, start_us, end_us, count, errors) in ``buckets`` rows from the first time to the last, empty buckets as well.

    The width is the span over the buckets in whole nanoseconds (of one second if there is no span; a millisecond at least), and the last bucket takes
    what is left over. Records without time don't count. No rows for no times, or for no buckets.
    The span is one row; the counts are one row a bucket before any exchange.
    """
    timed = records.where("ts_us is not null").select("ts_us", F.col("level").isin(*ERRORS).alias("is_error"))
    span = timed.agg(F.min("ts_us").alias("low"), F.max("ts_us").alias("high")).where(F.lit(buckets > 0) & F.col("low").isNotNull())
    length = F.when(F.col("high") == F.col("low"), F.lit(1_000_000)).otherwise(F.col("high") - F.col("low")) * 1000
    width = F.expr(f"{{}} div {max(1, buckets)}".format("length_ns"))
    span = span.withColumn("length_ns", length.cast("long")).withColumn("width", F.when(width == 0, F.lit(1_000_000)).otherwise(width).cast("long"))
    # One row joined to all, by broadcast: it can't be more.
    placed = timed.join(F.broadcast(span), F.lit(True)).withColumn("bucket", F.least(F.expr("((ts_us - low) * 1000) div width"), F.lit(buckets - 1)).cast("int"))
    counts = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(F.col("is_error").cast("long")), F.lit(0)).alias("errors"))
    dense = span.select("low", "width", F.explode(F.sequence(F.lit(0), F.lit(max(buckets, 1) - 1))).alias("bucket"))
    start = lambda k: F.expr(f"low + ((bucket + {k}) * width) div 1000")
    return dense.join(counts, "bucket", "left").select("bucket", start(0).alias("start_us"), start(1).alias("end_us"), F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("errors", F.lit(0)).alias("errors"))
