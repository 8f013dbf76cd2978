"""Records that match, in order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.aliases import Aliases
from ..plans.compiler import TIME, compile_query, field_of, promoted_fields

#: The order of records within a merged set: no sort by itself, but what ``in_order`` sorts by.
ORDER = ("order_us", "source_index", "line_number")
#: Lines of a source that one window looks back over.
STRETCH = 100_000


def matching(records: DataFrame, query: str = "", aliases: Aliases | None = None, now_us: int | None = None, search_raw: bool = False) -> DataFrame:
    """Records for which the query holds, with all their columns."""
    timed = dict(records.dtypes).get(TIME) == "timestamp_ntz"
    return records.where(compile_query(query, aliases, promoted=promoted_fields(records), now_us=now_us, search_raw=search_raw, for_filter=True, timed=timed))


def count(records: DataFrame) -> DataFrame:
    """One row: ``count``."""
    return records.agg(F.count(F.lit(1)).alias("count"))


def project(records: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The named fields as columns, empty where a record has none."""
    return records.select(*[F.coalesce(field_of(records, c), F.lit("")).alias(c) for c in columns])


def display_columns(records: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The named columns as they are shown: times to the second, levels in upper case, a message's first line, other fields as they are."""

    def shown(name: str):
        if name in ("timestamp", "time", "ts"):
            time = F.date_format(F.timestamp_micros("ts_us").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
            return F.when(F.col("ts_us").isNull(), "").otherwise(time)
        if name == "level":
            return F.upper(F.coalesce("level", F.lit("")))
        if name in ("message", "msg"):
            return F.substring_index(F.coalesce("message", F.lit("")), "\n", 1)
        return F.coalesce(field_of(records, name), F.lit(""))

    return records.select(*[shown(c).alias(c) for c in columns])


def stretch_ends(records: DataFrame) -> DataFrame:
    """(source_index, _stretch, _end): the last time in each stretch of a source's lines, null where it has none."""
    stretch = F.floor(F.coalesce("line_number", F.lit(0)) / STRETCH).alias("_stretch")
    return records.groupBy("source_index", stretch).agg(F.max(F.when(F.col("ts_us").isNotNull(), F.struct("line_number", "ts_us")))["ts_us"].alias("_end"))


def merge_timeline(records: DataFrame, ends: DataFrame | None = None, short: bool = False) -> DataFrame:
    """Records of several sources with ``order_us``: their own time, or that of the last record of their source that has one.

    A timed record orders itself. Only stretches without times look back, and only within their source: within ``STRETCH`` lines by a window, beyond by the last time
    of each stretch, so that a long source is many tasks. These are ``ends`` where they are known, else a second look at the records; ``short`` says that no source has a second stretch.
    """
    keys = ["source_index", "_stretch"]
    before = Window.partitionBy(*keys).orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    ordered = records.withColumn("_stretch", F.floor(F.coalesce("line_number", F.lit(0)) / STRETCH)).withColumn("order_us", F.last("ts_us", ignorenulls=True).over(before))
    if short:
        return ordered.drop("_stretch")
    earlier = Window.partitionBy("source_index").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    carried = (stretch_ends(records) if ends is None else ends).withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier))
    carried = carried.select(*[F.col(k).alias(f"_{k}") for k in keys], "_carried")
    joined = ordered.join(carried, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    return joined.withColumn("order_us", F.coalesce("order_us", "_carried")).drop("_carried", "_stretch", *[f"_{k}" for k in keys])


def in_order(records: DataFrame) -> DataFrame:
    """Sorted by time, source and line: a range sort, one global order."""
    return records.orderBy(*[F.col(c).asc_nulls_first() for c in ORDER if c in records.columns])


def keep_ids(records: DataFrame, ids: DataFrame, key: str = "record_id") -> DataFrame:
    """Records whose key is in ``ids`` (bookmarks, the members of a cluster)."""
    return records.join(ids.select(key).distinct(), key, "left_semi")


def between(records: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Records of a stretch of time, both ends in it."""
    return records.where(F.coalesce(F.col("ts_us").between(start_us, end_us), F.lit(False)))


def toggled(marks: DataFrame, ids: DataFrame, key: str = "record_id") -> DataFrame:
    """The bookmarks after each of ``ids`` was pressed once for every row it has: those that are set are taken away, others are set."""
    both = marks.select(key).distinct().unionByName(ids.select(key))
    return both.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").select(key)


def _places_per_stretch(places: DataFrame, key: str) -> int:
    """How many places wide a stretch is, so that places that are spread evenly come about ``STRETCH`` to each, with or without gaps."""
    n, low, high = places.agg(F.count(key), F.min(key).cast("long"), F.max(key).cast("long")).first()
    return 1 if not n else min(1 << 62, max(1, -(-(high - low + 1) * STRETCH // n)))


def next_marked(places: DataFrame, marks: DataFrame, key: str = "record_id") -> DataFrame:
    """``places`` (whose ``key`` is a record's place) with ``next``: the next marked place behind each, and behind the last one the first; null if there are no marks.

    Places and marks meet by stretches: within one by a running minimum from its end, beyond by the least mark of each stretch, so that neither is one list.
    A place that is null has the first mark behind it.
    """
    own = places.columns
    marked = marks.select(F.col(key).cast("long").alias("_mark")).where("_mark is not null").distinct()
    stretch = F.expr(f"_place div {_places_per_stretch(places, key)}L").alias("_stretch")
    rows = places.withColumn("_place", F.col(key).cast("long")).withColumn("_mark", F.lit(None).cast("long"))
    both = rows.where("_place is not null").unionByName(marked.withColumn("_place", F.col("_mark")), allowMissingColumns=True).select("*", stretch)
    within = Window.partitionBy("_stretch").orderBy(F.desc("_place"), F.asc_nulls_first("_mark")).rowsBetween(Window.unboundedPreceding, -1)  # a mark comes after its place
    later = Window.orderBy(F.desc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    ends = both.groupBy("_stretch").agg(F.min("_mark").alias("_least")).select("_stretch", F.min("_least").over(later).alias("_beyond"))
    found = both.withColumn("_ahead", F.min("_mark").over(within)).where("_mark is null").join(ends, "_stretch")
    found = found.select(*own, F.coalesce("_ahead", "_beyond").alias("next")).unionByName(rows.where("_place is null").select(*own, F.lit(None).cast("long").alias("next")))
    first = marked.agg(F.min("_mark").alias("_first"))
    return found.join(F.broadcast(first), F.lit(True)).select(*own, F.coalesce("next", "_first").alias("next"))
