"""A growing file as a stream.

The source is a streaming data source in Python: its offset is the byte after the last line feed, so that a line without its end waits for the next batch. The driver looks for line feeds at the
end only; the lines are read by executors, in partitions of some bytes each, from a path that they share. There is no word of files that shrink or are replaced.

``follow`` finds each batch's own entries, as when a file is looked at now and then: line numbers begin anew, and an entry that reaches over two batches is two. With ``across`` the
log's last entry is held back, beside the checkpoint, until a line begins the next one, or no line comes for a while; all others are found by as many tasks as a batch has.
"""

from __future__ import annotations

import io
import json
import os
import time
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..plans.aliases import Aliases
from ..plans.compiler import compile_query
from ..sources.files import begins_entry, group_entries, is_blank, mode_of, number_lines, parse_entries

FORMAT = "growing_file"
#: Bytes of a partition, and those in which a line feed is looked for at a time.
PARTITION_BYTES, LOOK_BYTES = 8 << 20, 1 << 16


def log_parts(path: str) -> list[str]:
    """The file alone; of a folder, its files in the order of their names: a log in parts, all but the last of which are whole lines and stay as they are. Hidden files are no parts."""
    if not os.path.isdir(path):
        return [path]
    return [p for name in sorted(os.listdir(path)) if name[0] not in "._" and os.path.isfile(p := os.path.join(path, name))]


def log_size(path: str) -> int:
    return sum(map(os.path.getsize, log_parts(path)))


class Parts(io.RawIOBase):
    """The parts of a log as one file, of which one part is open at a time."""

    def __init__(self, path: str) -> None:
        self.parts, self.starts, self.place = log_parts(path), [0], 0
        for p in self.parts:
            self.starts.append(self.starts[-1] + os.path.getsize(p))
        self.opened, self.file = -1, None

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = os.SEEK_SET) -> int:
        self.place = offset + {os.SEEK_SET: 0, os.SEEK_CUR: self.place, os.SEEK_END: self.starts[-1]}[whence]
        return self.place

    def readinto(self, buffer) -> int:
        if self.place >= self.starts[-1]:
            return 0
        k = bisect_right(self.starts, self.place) - 1
        if k != self.opened:
            if self.file:
                self.file.close()
            self.opened, self.file = k, open(self.parts[k], "rb", buffering=0)
        self.file.seek(self.place - self.starts[k])
        n = self.file.readinto(memoryview(buffer)[: self.starts[k + 1] - self.place])
        self.place += n
        return n

    def close(self) -> None:
        if self.file:
            self.file.close()
        super().close()


def open_log(path: str):
    return io.BufferedReader(Parts(path), LOOK_BYTES) if os.path.isdir(path) else open(path, "rb")


def last_line_end(path: str, low: int, high: int) -> int:
    """The byte after the last line feed in [low, high) of the file; ``low`` if there is none."""
    with open_log(path) as f:
        while high > low:
            begin = max(low, high - LOOK_BYTES)
            f.seek(begin)
            found = f.read(high - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            high = begin
    return low


def first_line_end(path: str, low: int, high: int) -> int | None:
    """The byte after the first line feed in [low, high) of the file."""
    with open_log(path) as f:
        f.seek(low)
        while low < high:
            data = f.read(min(LOOK_BYTES, high - low))
            found = data.find(b"\n")
            if found >= 0 or not data:
                return low + found + 1 if data else None
            low += len(data)
    return None


def lines_between(path: str, low: int, high: int, start: int) -> Iterator[str]:
    """The lines that begin in [low, high), without carriage returns at their ends; a line begins at ``start`` and after each line feed."""
    with open_log(path) as f:
        f.seek(low if low == start else low - 1)
        at = low if low == start else low - 1 + len(f.readline())
        while at < high:
            line = f.readline()
            at += len(line)
            yield line.rstrip(b"\n").decode("utf-8", "replace").rstrip("\r")


class Stretch(InputPartition):
    def __init__(self, low: int, high: int, start: int) -> None:
        self.low, self.high, self.start = low, high, start


class GrowingFileReader(DataSourceStreamReader):
    """A batch has ``most`` bytes at most, but for a longer line, and but for the first batch after a restart: that reaches to the present end, in as many partitions as it takes."""

    def __init__(self, path: str, start: int, most: int | None, partition: int, quiet_ms: int | None = None) -> None:
        self.path, self.start, self.most, self.partition, self.quiet_ms = path, start, most, partition, quiet_ms
        self.at: int | None = None  # where the last batch ended, if that is known
        self.bare = 0  # no line ends between there and here
        self.grown, self.quiet = time.time(), -1  # when lines last came, and the end at which none came for a while

    def initialOffset(self) -> dict:
        self.at = self.bare = self.start
        return {"byte": self.start}

    def latestOffset(self) -> dict:
        known, end = self.at, self._line_end()["byte"]
        if self.quiet_ms is None:
            return {"byte": end}
        if end != known:
            self.grown = time.time()
        elif end > self.start and time.time() > self.grown + self.quiet_ms / 1000:
            self.quiet = end
        return {"byte": end, "quiet": self.quiet}

    def _line_end(self) -> dict:
        size = log_size(self.path)
        low = self.start if self.at is None else self.at
        bound = size if self.most is None or self.at is None else min(size, low + self.most)
        bare = max(low, self.bare)
        end = last_line_end(self.path, bare, bound)
        if end == bare:  # the line goes beyond the bound, or isn't ended
            end = first_line_end(self.path, max(bound, bare), size)
        if end is None:
            self.bare = size
            return {"byte": low}
        self.at = self.bare = end
        return {"byte": end}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = max(self.at or 0, end["byte"])
        self.quiet = max(self.quiet, start.get("quiet", -1))
        edges = [*range(start["byte"], end["byte"], self.partition), end["byte"]]
        return [Stretch(a, b, start["byte"]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        for i, line in enumerate(lines_between(self.path, partition.low, partition.high, partition.start)):
            yield (partition.low, i, line)


class GrowingFile(DataSource):
    """``spark.readStream.format("growing_file").option("path", ...)``; ``startingByte`` to begin later in the file, ``maxBatchBytes`` to bound batches, ``partitionBytes``; with ``quietMs`` a batch without lines tells once that none have come for so long. A folder is a log in parts (see ``log_parts``)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "block long, at long, value string"

    def streamReader(self, schema) -> GrowingFileReader:
        most, quiet = self.options.get("maxBatchBytes"), self.options.get("quietMs")
        return GrowingFileReader(self.options["path"], int(self.options.get("startingByte", 0)), int(most) if most else None, int(self.options.get("partitionBytes", PARTITION_BYTES)), int(quiet) if quiet else None)


def follow_lines(spark: SparkSession, path: str, start: int = 0, most: int | None = None, partition: int = PARTITION_BYTES, quiet_ms: int | None = None) -> DataFrame:
    """The stream of new lines (block, at, value): ``at`` counts the lines of a block, and blocks ascend in the file."""
    spark.dataSource.register(GrowingFile)
    stream = spark.readStream.format(FORMAT).option("path", path).option("startingByte", start).option("partitionBytes", partition)
    stream = stream.option("maxBatchBytes", most) if most else stream
    return (stream if quiet_ms is None else stream.option("quietMs", quiet_ms)).load()


def batch_records(lines: DataFrame, multiline: str = "auto") -> DataFrame:
    """The records of one batch of lines."""
    rows = lines.select(F.lit("-").alias("path"), "block", "at", "value")
    if multiline == "auto":
        first = [r["value"].strip() for r in lines.orderBy("block", "at").limit(100).collect()]
        multiline = mode_of([x for x in first if x])
    return parse_entries(group_entries(number_lines(rows), multiline)).drop("path")


class OpenEntry:
    """A log's last entry after each batch, and how many lines there were: small files beside the checkpoint, of which those of the last two batches stay, so that a batch can be done again."""

    def __init__(self, spark: SparkSession, checkpoint: str) -> None:
        self.spark, self.folder = spark, f"{checkpoint.rstrip('/')}/open-entries"

    def _at(self, number: int):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{number}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def before(self, number: int) -> tuple[int, list[tuple[int, str]]]:
        """How many lines there were, and those of the open entry with their numbers."""
        path, system = self._at(number - 1)
        if not system.exists(path):
            return 0, []
        stream = system.open(path)
        try:
            count, lines = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return count, [tuple(x) for x in lines]

    def keep(self, number: int, count: int, lines: list[tuple[int, str]]) -> None:
        path, system = self._at(number)
        stream = system.create(path, True)
        try:
            stream.write(bytearray(json.dumps([count, lines]).encode()))
        finally:
            stream.close()
        old, system = self._at(number - 2)
        system.delete(old, False)


def entries_across(lines: DataFrame, multiline: str, count: int, held: list[tuple[int, str]]) -> tuple[DataFrame, int, list[tuple[int, str]]]:
    """Whole entries (path, line_number, text) of a batch of lines (block, at, value) behind ``count`` earlier ones, of which ``held`` are those of the open entry; then both of these anew.

    The driver sees the last entry's lines only. A batch without lines ends the open entry.
    """
    spark, schema = lines.sparkSession, "path string, line_number long, value string"
    numbered = number_lines(lines.select(F.lit("-").alias("path"), "block", "at", "value")).select("path", (F.col("line_number") + count).alias("line_number"), "value")
    before = spark.createDataFrame([("-", n, value) for n, value in held], schema)
    begun, first, last = numbered.agg(F.max(F.when(begins_entry(F.lit(multiline)), F.col("line_number"))), F.min(F.when(~is_blank(), F.col("line_number"))), F.max("line_number")).first()
    if last is None:
        return group_entries(before, multiline), count, []
    opens = begun if begun is not None else held[0][0] if held else first
    if opens is None:  # blank lines, and no entry that they could go on with
        return group_entries(before, multiline), last, []
    new = [(r["line_number"], r["value"]) for r in numbered.where(F.col("line_number") >= opens).collect()]
    rest = [x for x in held if x[0] >= opens]
    return group_entries(before.unionByName(numbered).where(F.col("line_number") < opens), multiline), last, rest + sorted(new)


def follow(spark: SparkSession, path: str, query: str, on_batch: Callable[[DataFrame, int], None], checkpoint: str, aliases: Aliases | None = None, start: int = 0, once: bool = False, every: str = "500 milliseconds", most: int | None = None, across: str | None = None, wait_ms: int = 2000):
    """Starts a streaming query that gives the matching records of each batch to ``on_batch``. ``last:`` counts from each batch's time. ``once`` stops at the present end; else ``most`` bounds
    a batch's bytes. ``across`` (``timed`` or ``structured``) finds entries across batches, the last of which comes after ``wait_ms`` without a line."""
    lines = follow_lines(spark, path, start, None if once else most, quiet_ms=wait_ms if across and not once else None)
    open_entry = OpenEntry(spark, checkpoint)

    def run(batch: DataFrame, number: int) -> None:
        condition = compile_query(query, aliases, now_us=time.time_ns() // 1000, for_filter=True)
        batch = batch.persist()  # lines are read once
        try:
            if across:
                entries, count, held = entries_across(batch, across, *open_entry.before(number))
                on_batch(parse_entries(entries).drop("path").where(condition), number)
                open_entry.keep(number, count, held)
            else:
                on_batch(batch_records(batch).where(condition), number)
        finally:
            batch.unpersist()

    writer = lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def follow_directory(spark: SparkSession, path: str) -> DataFrame:
    """Records of files that come into a directory, a line an entry: stateless, on Spark's own file source."""
    from ..sources.records import with_records

    lines = spark.readStream.option("lineSep", "\n").text(path)
    value = F.regexp_replace("value", r"\r\z", "")
    named = lines.where(F.trim("value") != "").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"), value.alias("text"))
    return with_records(named, F.col("text")).select("source", "_record.*")


def counts_over_time(records: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, end, level, count) of a stream of records by event time; what is later than ``late`` is dropped."""
    timed = records.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "level").agg(F.count(F.lit(1)).alias("count")).select("window.start", "window.end", "level", "count")
