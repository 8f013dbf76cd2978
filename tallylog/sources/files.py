"""Log files as records.

Files are read as lines in splits, as Spark reads any text. Line numbers and entries are running counts: within a split by a window, across splits by
the splits' totals, so that one large file is still many tasks.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import PARSED
from .entries import Record, parse_entry
from .records import with_records

# How an entry's first line begins, by time or by structure; what of the first lines decides.
TIME_START = (
    r"^(?:[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}"
    r"|[0-9]{2}[-/][0-9]{2}[-/][0-9]{4}"
    r"|[0-9]{1,2}:[0-9]{2}:[0-9]{2}"
    r"|[0-9]{2}/[A-Z][a-z]{2}/[0-9]{4}"
    r"|[A-Z][a-z]{2}[\t\n\f\r ]+[0-9]{1,2}[\t\n\f\r ]+[0-9]{2}:[0-9]{2}:[0-9]{2}"
    r"|[0-9]{10,13}[\t\n\f\r ,])"
)
STRUCTURE_START = r"^(?:[{\[]|[0-9A-Za-z_]+=)"
SAMPLE_LINES, MOSTLY, PARTLY, SOME, AT_LEAST = 100, 0.8, 0.3, 0.02, 2

#: Bytes of an unzipped file that become rows at a time; bytes of a file in which its first lines are looked for.
UNZIPPED_BYTES, HEAD_BYTES = 8 << 20, 1 << 20
GZIP = b"\x1f\x8b"

_SCHEME = "^[A-Za-z0-9]+:/+"
_TRIMMED = r"(?U)^\s+|\s+$"


def head_of(spark: SparkSession, path: str, most: int) -> bytes:
    """The file's first bytes, ``most`` at most."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).open(hadoop)
    try:
        return bytes(stream.readNBytes(most))
    finally:
        stream.close()


def parts_of(spark: SparkSession, path: str) -> list[str]:
    """The file alone; of a folder, the files that hold one log between them, in the order of their names, as ``save_rows`` and rotation leave them. Hidden ones and folders in it are no parts."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.getFileStatus(hadoop).isDirectory():
        return [path]
    found = [f.getPath() for f in system.listStatus(hadoop) if f.isFile()]
    return [p.toString() for p in sorted(found, key=lambda p: p.getName()) if p.getName()[0] not in "._"]


def is_gzip(spark: SparkSession, path: str) -> bool:
    """Whether the file begins with gzip's two bytes, whatever its name."""
    return head_of(spark, path, 2) == GZIP


def _unzipped_head(head: bytes) -> bytes:
    try:
        return zlib.decompressobj(wbits=31).decompress(head, HEAD_BYTES) if head[:2] == GZIP else head
    except zlib.error:
        return b""


def mode_of_file(spark: SparkSession, path: str) -> str:
    """A log's mode by its first lines, of which ``HEAD_BYTES`` at most of a file are looked at; where a part is shorter than that, the next one goes on."""
    parts = parts_of(spark, path)
    for size in (HEAD_BYTES // 16, HEAD_BYTES):
        head, packed = b"", b""
        for part in parts:
            packed = head_of(spark, part, size)
            head += _unzipped_head(packed)
            if head.count(b"\n") >= SAMPLE_LINES or len(packed) >= size:
                break
        if head.count(b"\n") >= SAMPLE_LINES or len(packed) < size:
            break
    lines = head.decode("utf-8", "replace").split("\n")[:SAMPLE_LINES]
    return mode_of([x for x in map(str.strip, lines) if x])


def mode_of(lines: list[str]) -> str:
    """The mode that a file's first lines, trimmed and without blank ones, speak for."""
    if not lines:
        return "single"
    structured, timed = (sum(bool(re.search(p, x, re.ASCII)) for x in lines) for p in (STRUCTURE_START, TIME_START))
    if structured / len(lines) >= MOSTLY:
        return "single"
    if structured / len(lines) > PARTLY:
        return "structured"
    return "timed" if timed / len(lines) > SOME and timed >= AT_LEAST else "single"


def _each(paths: Sequence[str], look) -> list:
    """``look`` at every path, many at a time: all that is done per file on the driver is a look at its name and first lines."""
    with ThreadPoolExecutor(32) as pool:
        return list(pool.map(look, paths))


def _unzipped(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of gzip files whose names don't tell; each is one task, as gzip can't be split. They are unzipped some bytes at a time; packed, Spark holds up to 2 GB of such a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                at, lines = 0, gzip.GzipFile(fileobj=io.BytesIO(content))
                while some := lines.readlines(UNZIPPED_BYTES):
                    yield pd.DataFrame({"path": path, "block": 0, "at": range(at, at + len(some)), "value": [x.removesuffix(b"\n").decode("utf-8", "replace") for x in some]})
                    at += len(some)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "path string, block long, at long, value string")


#: A part's blocks have numbers from its place in the log times this on: files are shorter.
PART = 1 << 44


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, block, at, value): every line, in which split of which file, and a number that grows along the split. A folder is one log in parts (see ``parts_of``), whose blocks follow each other."""
    logs = dict(zip(paths, _each(paths, lambda p: parts_of(spark, p)), strict=True))
    paths = [p for parts in logs.values() for p in parts]
    doubtful = [p for p in paths if not p.endswith(".gz")]
    odd = {p for p, zipped in zip(doubtful, _each(doubtful, lambda p: is_gzip(spark, p)), strict=True) if zipped}
    plain = [p for p in paths if p not in odd]
    parts = [_unzipped(spark, sorted(odd))] if odd else []
    if plain:
        text = spark.read.option("lineSep", "\n").text(plain)
        parts.append(text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"))
    if not parts:
        return spark.createDataFrame([], "path string, block long, at long, value string")
    lines = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    places = [(_file_key(spark, p), _file_key(spark, log), i * PART) for log, found in logs.items() if found != [log] for i, p in enumerate(found)]
    if places:
        table = _small(spark.createDataFrame(places, "_name string, _log string, _shift long"), len(places))
        lines = lines.withColumn("_name", F.regexp_replace("path", _SCHEME, "/")).join(table, "_name", "left")
        lines = lines.select(F.coalesce("_log", "path").alias("path"), (F.col("block") + F.coalesce("_shift", F.lit(0))).alias("block"), "at", "value")
    return lines.withColumn("value", F.regexp_replace("value", r"\r\z", ""))


#: Splits or files up to which tables of one row for each are broadcast; beyond, lines are shuffled to meet them.
BROADCAST_SPLITS = 100_000


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_SPLITS else table


def _n_splits(lines: DataFrame) -> int:
    """No fewer than there are: Spark's partitions hold at most so many splits as there are files more."""
    return lines.rdd.getNumPartitions() + len(lines.inputFiles())


def _before(splits: DataFrame, amount: str, place: str = "block") -> DataFrame:
    """(path, block, _before) from (path, block, amount): what earlier splits of the file have."""
    earlier = Window.partitionBy("path").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn("_before", F.coalesce(F.sum(amount).over(earlier), F.lit(0)))


def number_lines(lines: DataFrame) -> DataFrame:
    """With ``line_number``, from 1 in each file. ``at`` goes up by one within a split, so a split's first number and how many lines earlier splits have are enough: the lines themselves aren't moved."""
    splits = _before(lines.groupBy("path", "block").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n")), "_n").drop("_n")
    numbered = lines.join(_small(splits, _n_splits(lines)), ["path", "block"])
    return numbered.withColumn("line_number", F.col("at") - F.col("_first") + F.col("_before") + 1).drop("_first", "_before")


def is_blank() -> Column:
    return F.regexp_replace("value", _TRIMMED, "") == ""


def begins_entry(mode: Column) -> Column:
    """Whether a line begins an entry by itself."""
    return ~is_blank() & F.when(mode == "timed", F.col("value").rlike(TIME_START)).otherwise(F.col("value").rlike(STRUCTURE_START))


#: Lines of a file over which one window counts entries.
WINDOW_LINES = 50_000


def group_entries(lines: DataFrame, multiline: str | dict[str, str] = "single") -> DataFrame:
    """(path, line_number, text) of entries. ``multiline``: a mode for all files, or the modes of those that aren't ``single``, by path without scheme.

    In a grouped file an entry's first line begins as its mode says; other lines go on with the entry, blank ones as well, and the first line that isn't blank always begins one.
    Where all files are of one line per entry, as most are, nothing is grouped.
    """
    blank = is_blank()
    if multiline == "single" or not multiline:
        return lines.where(~blank).select("path", "line_number", F.col("value").alias("text"))
    if isinstance(multiline, dict):
        found = _small(lines.sparkSession.createDataFrame(list(multiline.items()), "_name string, mode string"), len(multiline))
        moded = lines.withColumn("_name", F.regexp_replace("path", _SCHEME, "/")).join(found, "_name", "left").fillna("single", ["mode"]).drop("_name")
    else:
        moded = lines.withColumn("mode", F.lit(multiline))
    single = moded.where((F.col("mode") == "single") & ~blank).select("path", "line_number", F.col("value").alias("text"))
    grouped = moded.where("mode != 'single'").withColumn("blank", blank)
    opened = grouped.where("not blank").groupBy("path").agg(F.min("line_number").alias("_opens"))
    grouped = grouped.join(opened, "path").withColumn("_begin", (begins_entry(F.col("mode")) | (F.col("line_number") == F.col("_opens"))).cast("long"))
    # Running counts: within a stretch of lines by a window, so that no task holds more than that at once, and over stretches by their sums.
    grouped = grouped.select("path", "line_number", "value", "_begin", F.floor(F.col("line_number") / WINDOW_LINES).alias("_piece"))
    along = Window.partitionBy("path", "_piece").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    pieces = _before(grouped.groupBy("path", "_piece").agg(F.sum("_begin").alias("_n")), "_n", "_piece").drop("_n")
    counted = grouped.withColumn("_entry", F.sum("_begin").over(along)).join(pieces, ["path", "_piece"]).withColumn("_entry", F.col("_entry") + F.col("_before"))
    entries = counted.where("_entry > 0").groupBy("path", "_entry").agg(F.min("line_number").alias("line_number"), F.array_sort(F.collect_list(F.struct("line_number", "value"))).alias("_lines"))
    return single.unionByName(entries.select("path", "line_number", F.array_join(F.col("_lines.value"), "\n").alias("text")))


_MAP = pa.map_(pa.string(), pa.string())
NOTHING = Record(None, None, None, None, None)


@F.arrow_udf(PARSED)
def parse_log(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The record of each entry's text; nothing for null."""
    for texts in batches:
        rows = [NOTHING if t is None else parse_entry(t) for t in texts.to_pylist()]
        yield pa.StructArray.from_arrays([
            pa.array([r.ts_us for r in rows], pa.int64()), pa.array([r.level for r in rows], pa.string()), pa.array([r.message for r in rows], pa.string()),
            pa.array([r.fields and list(r.fields.items()) for r in rows], _MAP), pa.array([r.raw for r in rows], pa.string()),
        ], PARSED.names)


#: Evaluated once an entry: filters on records aren't pushed below it, where each would write the parsing out anew.
parse_log = parse_log.asNondeterministic()


def parse_entries(entries: DataFrame, source=None) -> DataFrame:
    """Records of (line_number, text) and other columns, which stay. With ``source``, that is a field, too, and goes before one of the entry's own."""
    kept = [c for c in entries.columns if c not in ("text", "line_number")]
    out = with_records(entries, F.col("text")).select(*kept, "line_number", "_record.*")
    if source is None:
        return out.withColumn("source", F.lit(None).cast("string"))
    merged = F.map_concat(F.map_filter("fields", lambda k, v: k != "source"), F.create_map(F.lit("source"), F.col("source")))
    return out.withColumn("source", source).withColumn("fields", merged)


def read_logs(spark: SparkSession, paths: Sequence[str], multiline: str = "auto") -> DataFrame:
    """Records of the files: source, line_number, ts_us, level, message, fields, raw, and source_index (the file's place among ``paths``).

    With several files each record has its file's name as ``source``, and ``order_us`` for a common timeline (see ``merge_timeline``).
    """
    from ..operators.rows import merge_timeline

    keys = _each(paths, lambda p: _file_key(spark, p))
    if multiline == "auto":
        multiline = {k: m for k, m in zip(keys, _each(paths, lambda p: mode_of_file(spark, p)), strict=True) if m != "single"}
    entries = group_entries(number_lines(read_lines(spark, list(paths))), multiline)
    names = {name: i for i, name in reversed(list(enumerate(keys)))}
    places = spark.createDataFrame(list(names.items()), "_name string, source_index int")
    placed = entries.withColumn("_name", F.regexp_replace("path", _SCHEME, "/")).join(_small(places, len(names)), "_name", "left").drop("_name")
    if len(paths) == 1:
        return parse_entries(placed.drop("path"))
    records = parse_entries(placed, F.element_at(F.split("path", "/"), -1)).drop("path")
    ends = last_times(placed)
    return merge_timeline(records, ends, short=ends is None)


#: Lines at a stretch's end in which its last time is looked for first.
TAIL_LINES = 200


def last_times(entries: DataFrame) -> DataFrame | None:
    """The last time of each stretch of a source's entries (see ``stretch_ends``); None where no source has more than one stretch.

    Looked for now, so that records of several files are parsed once: only the last lines of stretches are parsed, and whole stretches only where no time is found in these.
    """
    from ..operators.rows import STRETCH, stretch_ends

    spark, number = entries.sparkSession, F.col("line_number")

    def ends(some: DataFrame, text: Column) -> DataFrame:
        return stretch_ends(with_records(some.select("source_index", "line_number", "text"), text).select("source_index", "line_number", "_record.ts_us"))

    rows = ends(entries, F.when(number % STRETCH >= STRETCH - TAIL_LINES, F.col("text"))).limit(BROADCAST_SPLITS + 1).collect()  # one row for STRETCH lines
    if len(rows) > BROADCAST_SPLITS:
        return ends(entries, F.col("text"))
    final: dict[int, int] = {}
    for r in rows:
        final[r["source_index"]] = max(final.get(r["source_index"], 0), r["_stretch"])
    if not any(final.values()):
        return None
    known = {(r["source_index"], r["_stretch"]): r["_end"] for r in rows}
    open_ = [k for k, end in known.items() if end is None and k[1] < final[k[0]]]
    if open_:
        wanted = spark.createDataFrame(open_, "source_index int, _stretch long")
        again = entries.withColumn("_stretch", F.floor(number / STRETCH)).join(F.broadcast(wanted), ["source_index", "_stretch"])
        known |= {(r["source_index"], r["_stretch"]): r["_end"] for r in ends(again, F.col("text")).collect()}
    return spark.createDataFrame([(*k, v) for k, v in known.items()], "source_index int, _stretch long, _end long")


def _file_key(spark: SparkSession, path: str) -> str:
    """The full path, without the scheme, which is written in more than one way."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub(_SCHEME, "/", hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).getPath().toString())


def from_lines(spark: SparkSession, lines: Sequence[str], multiline: str = "auto") -> DataFrame:
    """Records of lines that the driver holds, such as its standard input."""
    rows = spark.createDataFrame([("-", 0, i, line.rstrip("\n").removesuffix("\r")) for i, line in enumerate(lines)], "path string, block long, at long, value string")
    if multiline == "auto":
        multiline = mode_of([x for x in (line.strip() for line in lines[:SAMPLE_LINES]) if x])
    return parse_entries(group_entries(number_lines(rows), multiline)).drop("path").withColumn("source_index", F.lit(0))
