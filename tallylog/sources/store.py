"""Records kept for look-ups: clustered by time, with an index of files.

A save is a range sort by day and time into Parquet files, partitioned by day, with Bloom filters on the fields named as identifiers. Beside them, ``index`` has a row for each file: its day, its first
and last time, its rows, and which trigrams the values of its fields have (hashed to 16 bits, so at most 65,536 numbers a file, however large). A query's tree becomes a condition on that index
first: files that can't have a matching record aren't opened. What is left is read with the query's own filter, which is pushed into the scan where fields have columns.

Saves are appends. ``compact`` writes a day's files anew as few ones; the new files' rows and the words that the old ones are gone come with one write of the index, so that readers see either.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from ..functions.timestamps import parse_timestamp
from ..operators.rows import matching
from ..plans import language as q
from ..plans.aliases import Aliases
from ..plans.compiler import PROMOTED, now_micros, promote

DAY_US, NO_DAY = 86_400_000_000, "none"
TRIGRAM_BITS = 16
#: Rows of a file at most.
FILE_ROWS = 1_000_000


def _trigrams(folded: Column) -> Column:
    """Hashes of a text's runs of three characters. The text has small ASCII letters for capital ones already, and is a column or a lambda's variable, as it is evaluated once for each run."""
    return F.when(F.length(folded) >= 3, F.transform(F.sequence(F.lit(1), F.length(folded) - 2), lambda i: F.pmod(F.xxhash64(F.substring(folded, i, F.lit(3))), F.lit(1 << TRIGRAM_BITS)).cast("int"))).otherwise(F.array().cast("array<int>"))


def _day(ts_us: Column) -> Column:
    return F.coalesce(F.date_from_unix_date(F.floor(ts_us / DAY_US).cast("int")).cast("string"), F.lit(NO_DAY))


def _write(records: DataFrame, path: str, ids: Iterable[str], file_rows: int) -> DataFrame:
    """Files of one save, in a folder of their own, read again."""
    where = f"{path}/records/batch={uuid.uuid4().hex}"
    placed = records.withColumn("day", _day(F.col("ts_us"))).repartitionByRange("day", F.col("ts_us").asc_nulls_first(), F.xxhash64("line_number", "raw")).sortWithinPartitions("day", "ts_us")
    writer = placed.write.partitionBy("day").option("maxRecordsPerFile", file_rows)
    for name in ids:
        writer = writer.option(f"parquet.bloom.filter.enabled#{PROMOTED}{name}", "true").option(f"parquet.bloom.filter.expected.ndv#{PROMOTED}{name}", file_rows)
    writer.parquet(where)
    return records.sparkSession.read.schema(placed.schema).parquet(where)


def _described(saved: DataFrame) -> DataFrame:
    """Index rows of a save's files."""
    rows = saved.select(F.col("_metadata.file_path").alias("file"), "day", "ts_us", "fields")
    sizes = rows.groupBy("file", "day").agg(F.min("ts_us").alias("low"), F.max("ts_us").alias("high"), F.count(F.lit(1)).alias("n"))
    values = F.array_distinct(F.flatten(F.transform(F.transform(F.map_values("fields"), ascii_lower), _trigrams)))
    sets = rows.select("file", F.explode(values).alias("t")).distinct().groupBy("file").agg(F.array_sort(F.collect_list("t")).alias("trigrams"))
    return sizes.join(sets, "file", "left").select("file", F.col("day").cast("string").alias("day"), "low", "high", "n", F.coalesce("trigrams", F.array().cast("array<int>")).alias("trigrams"), F.lit(False).alias("gone"))


def _add_to_index(rows: DataFrame, path: str) -> None:
    """Appends index rows as one file, which readers see at once or not at all. The rows are made by many tasks first; the one that writes them has no more to do than that."""
    spark, made = rows.sparkSession, f"{path}/index-{uuid.uuid4().hex}"
    rows.write.parquet(made)
    spark.read.schema(rows.schema).parquet(made).coalesce(1).write.mode("append").parquet(f"{path}/index")
    folder = spark._jvm.org.apache.hadoop.fs.Path(made)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def save_records(records: DataFrame, path: str, promoted: Iterable[str] = (), ids: Iterable[str] = (), file_rows: int = FILE_ROWS) -> None:
    """Adds records to the store at ``path``. ``promoted`` fields get columns; of these ``ids`` (which are promoted, too) get Bloom filters. Records without time have a partition of their own; no records add nothing."""
    ids = list(ids)
    _add_to_index(_described(_write(promote(records, [*promoted, *ids]), path, ids, file_rows)), path)


def _live(spark: SparkSession, path: str) -> DataFrame:
    index = spark.read.parquet(f"{path}/index")
    return index.where(~F.col("gone")).join(index.where("gone").select("file"), "file", "left_anti")


def file_condition(node: q.Node, now_us: int) -> Column:
    """Whether a file of the index may have a record for which the tree holds."""

    def has(text: str) -> Column:
        wanted = _trigrams(ascii_lower(F.lit(text)))
        return F.size(F.array_except(wanted, F.col("trigrams"))) == 0 if len(text) >= 3 else F.lit(True)

    def time_is(op: str, bound: int | None) -> Column:
        if bound is None:
            return F.lit(False)
        return F.coalesce({">": F.col("high") > bound, ">=": F.col("high") >= bound, "<": F.col("low") < bound, "<=": F.col("low") <= bound}[op], F.lit(False))

    def walk(n: q.Node) -> Column:
        match n:
            case q.FieldMatch(name, value) if name != "level":
                return has(value)
            case q.FullText(text):
                return has(text)
            case q.TimeCompare(_, op, value):
                return time_is(op, parse_timestamp(value))
            case q.RelativeTime(duration):
                return time_is(">=", now_us - q.duration_micros(duration))
            case q.And(left, right):
                return walk(left) & walk(right)
            case q.Or(left, right):
                return walk(left) | walk(right)
        return F.lit(True)

    return walk(node)


def files_for(spark: SparkSession, path: str, query: str = "", aliases: Aliases | None = None, now_us: int | None = None) -> list[tuple[str, str]]:
    """(file, day) of the files to be read for a query."""
    node = q.parse((aliases or Aliases()).expand(query))
    found = _live(spark, path).where(file_condition(node, now_micros() if now_us is None else now_us)).select("file", "day")
    return sorted(tuple(r) for r in found.collect())  # names of files, as a scan lists them


def _read(spark: SparkSession, path: str, files: list[tuple[str, str]]) -> DataFrame:
    reader = spark.read.option("basePath", f"{path}/records")
    if not files:  # any file tells the columns
        some = spark.read.parquet(f"{path}/index").select("file").head()
        if some is None:
            raise ValueError(f"there are no records in {path}")
        return reader.parquet(some["file"]).where(F.lit(False)).drop("batch", "day")
    days = sorted({d for _, d in files})
    return reader.parquet(*[f for f, _ in files]).where(F.col("day").cast("string").isin(days)).drop("batch", "day")


def look_up(spark: SparkSession, path: str, query: str = "", aliases: Aliases | None = None, now_us: int | None = None) -> DataFrame:
    """The store's records that match, from the files that may have some. Words are looked for in fields, as always (see ``matching``)."""
    now_us = now_micros() if now_us is None else now_us
    return matching(_read(spark, path, files_for(spark, path, query, aliases, now_us)), query, aliases, now_us=now_us)


def compact(spark: SparkSession, path: str, day: str, ids: Iterable[str] = (), file_rows: int = FILE_ROWS) -> None:
    """Writes a day's files (``none``: those without times) anew, sorted by time over all saves. The old files stay on disk, unread, until their owner removes them."""
    old = _live(spark, path).where(F.col("day") == day).select("file", "day", "low", "high", "n")
    files = [(r["file"], r["day"]) for r in old.collect()]
    if len(files) < 2:
        return
    new = _described(_write(_read(spark, path, files), path, ids, file_rows))
    gone = spark.createDataFrame([(f, d, None, None, None, [], True) for f, d in files], spark.read.parquet(f"{path}/index").select(*new.columns).schema)
    _add_to_index(new.unionByName(gone), path)
