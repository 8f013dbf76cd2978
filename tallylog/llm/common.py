"""What the operators share: work tables, digests, words and distributed ranks."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_LOCAL: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """The shared folder for work tables: ``spark.checkpoint.dir``. Where that is unset, a temporary one if Spark runs on one machine (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "")
        if not base:
            base = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="tallylog-")
    return base.rstrip("/")


def stage_table(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, and survives lost executors.

    The folder's name is new each time, so that concurrent jobs never meet. ``file_rows`` bounds the rows of a file (0: no bound), where rows are large: a file's
    row group goes to one task, whatever its size.
    """
    spark = df.sparkSession
    path = f"{work_root(spark)}/tallylog-{uuid.uuid4().hex}/{name}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """What Arrow's pool keeps of batches that are done goes back to the machine: a Python worker lives on beside its executor, and is used for other stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def md5_long(*cols: Column, salt: str = "") -> Column:
    """First 32 bits of an MD5 over the values as text, as a non-negative long; engines other than Spark can compute it too."""
    text = F.concat_ws("\x1f", F.lit(salt), *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long"), F.lit(0).cast("long"))


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 1; null counts as no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def salts_for(rows: int, per_cell: int = 100_000, least: int = 16, most: int = 1 << 14) -> int:
    """A power of two of sub-cells, in step with the number of rows, into which a hot group is dealt."""
    return min(most, max(least, 1 << max(0, math.ceil(math.log2(max(1, rows / per_cell))))))


def cell_offsets(cells: DataFrame, group: list[str], cell: list[str], n: str = "_n") -> DataFrame:
    """Adds ``_offset``: rows of the group in earlier cells. ``cells`` has one row per cell, so a window sees counts only."""
    before = Window.partitionBy(*group).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("_offset", F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that don't clash with the frame's own (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def positional(df: DataFrame, *names: str) -> tuple:
    """``df`` with its columns named c0, c1 ..., and the new names of those given: no name of an operator's own can clash then."""
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(df.columns)))}
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), *[at[n] for n in names]


def restored(df: DataFrame, columns: list[str]) -> list[Column]:
    """The columns that ``positional`` renamed, under their old names."""
    return [F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]
