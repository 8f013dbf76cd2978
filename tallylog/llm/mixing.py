"""Mixing sources to target weights by systematic sampling.

Within a source the documents' expected copies are prefix-summed, one random offset in [0, 1) a source is added, and a document is emitted once for each integer its
interval crosses. Documents stand in octaves of size, the longest first; within an octave they have the same expected copies, the words still wanted over the words still to come.
So what a long document takes too much or too little is made good by the shorter ones after it, and the words taken end near the target even in a small source.

The prefix sum is distributed: documents fall into cells (source, octave and, where rows are many, exact size and leading bits of the id's hash), whose counts are
summed first; a rank within the cell does the rest. A source that holds a third of all rows is thus dealt over hundreds of cells.
The order is the same however many cells there are: source, octave, size, hash, id. An octave is one narrow job over its own rows; only the sources' sums go on to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cell_offsets, fresh, md5_long, n_words, positional, restored, salts_for, stage_table

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3


def source_targets(sources: DataFrame, weights=WEIGHTS, most_copies: int = MOST_COPIES) -> DataFrame:
    """(_null, _source, _source_size, _target) from (_null, _source, _source_size); every step is distributed, as sources may be many.

    Ranks come from a range sort; the share a unit of weight gets is raised until the sources that stop at their cap are all known.
    """
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage_table(sources.repartitionByRange(parts, "_null", "_source").withColumn("_pid", F.spark_partition_id()), "sources")
    counts = sorted((r["_pid"], r["n"]) for r in dealt.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for pid, n in counts:
        offsets.append((pid, before))
        before += n
    starts = spark.createDataFrame(offsets, "_pid int, _before long")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_pid").orderBy("_null", "_source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = dealt.join(F.broadcast(starts), "_pid").withColumn("_weight", weight).withColumn("_cap", most_copies * F.col("_source_size")).drop("_pid", "_before")
    ranked = stage_table(ranked, "weights")
    share, stopped = 0.0, -1
    while True:
        full = F.col("_cap") <= F.lit(share) * F.col("_weight")
        r = ranked.agg(
            F.coalesce(F.sum("_source_size"), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0)).alias("open"),
            F.coalesce(F.sum(full.cast("long")), F.lit(0)).alias("n"),
        ).first()
        if r["n"] == stopped or not r["open"]:
            break
        stopped, share = r["n"], (r["all"] - r["capped"]) / r["open"]
    return ranked.select("_null", "_source", "_source_size", F.least(F.col("_cap").cast("double"), F.lit(float(share)) * F.col("_weight")).alias("_target"))


def _crossed(place, rate, rank, most_copies: int):
    """Integers in (place + rate * (rank - 1), place + rate * rank]. The least() only guards against rounding of a product."""
    return F.least(F.lit(most_copies), F.floor(place + rate * rank) - F.floor(place + rate * (rank - 1))).cast("int")


def octave_rates(ranked: DataFrame, targets: DataFrame, octaves: list[int], most_copies: int, seed: str) -> DataFrame:
    """(_null, _source, _octave, _place, _rate): expected copies of a document of each octave, and their sum before it. ``ranked``: (_null, _source, _octave, _k, _size)."""
    keys = ["_null", "_source"]
    start = md5_long(F.col("_null"), F.col("_source"), salt=seed) / F.lit(float(1 << 32))
    state = targets.select(*keys, start.alias("_place"), F.col("_target").alias("_wanted"), F.col("_source_size").alias("_ahead"))
    rates = []
    for octave in sorted(octaves, reverse=True):
        rate = F.greatest(F.lit(0.0), F.least(F.lit(float(most_copies)), F.when(F.col("_ahead") > 0, F.col("_wanted") / F.col("_ahead")).otherwise(F.lit(0.0))))
        state = state.withColumns({"_rate": rate, "_octave": F.lit(octave)})
        here = ranked.where(F.col("_octave") == octave).select(*keys, "_k", "_size").join(state.select(*keys, "_place", "_rate"), keys)
        sums = here.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words"), F.sum(F.col("_size") * _crossed(F.col("_place"), F.col("_rate"), F.col("_k"), most_copies)).alias("_taken"))
        none = F.lit(0).cast("long")
        state = stage_table(state.join(sums, keys, "left").withColumns({c: F.coalesce(c, none) for c in ("_n", "_words", "_taken")}).coalesce(8), "octave")
        rates.append(state.where("_n > 0").select(*keys, "_octave", "_place", "_rate"))
        state = state.select(*keys, (F.col("_place") + F.col("_n") * F.col("_rate")).alias("_place"), (F.col("_wanted") - F.col("_taken")).alias("_wanted"), (F.col("_ahead") - F.col("_words")).alias("_ahead"))
    found = rates[0]
    for r in rates[1:]:
        found = found.unionByName(r)
    return found


def systematic_mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, most_copies: int = MOST_COPIES, seed: str = "mix", carry: bool = True) -> DataFrame:
    """Every row of ``df`` with ``size``, ``source_size``, ``target`` and ``copies`` (times the mix takes it, 0 to ``most_copies``).

    Without ``carry`` only the id and these are returned, and texts are read once. Null source: a source of its own, after all others. Null text: size 0. A source
    without words has target 0 and gives no copies. Ties go by a hash of the id, then the id. Rows repeated in full get copies as any others, the same multiset on each
    run. Empty input: no rows. New columns whose names clash with ``df``'s own get leading underscores.
    """
    own = df.columns if carry else [id_col]
    out_names = fresh(df.select(*[f"`{c}`" for c in own]), "size", "source_size", "target", "copies")
    df, id_col, source_col, text_col = positional(df, id_col, source_col, text_col)
    group, size = ["_null", "_source", "_octave"], "_size"
    keys = [*group, "_fine", "_top"]
    bits = max(0, (salts_for(df.count()) // 16).bit_length() - 1)

    def keyed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"_null": F.col(source_col).isNull(), "_source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "_octave": F.expr(f"coalesce(cast(length(bin(`{size}`)) as int), 1)"), "_order": md5_long(F.col(id_col), salt=seed)})
        return rows.withColumns({"_fine": F.col(size) if bits else F.lit(0).cast("long"), "_top": F.coalesce(F.shiftright("_order", 32 - bits), F.lit(0)).cast("int") if bits else F.lit(0)})

    counted = keyed(df.withColumn(size, n_words(F.col(text_col)))).select(*keys, size, "_order", id_col)
    counted = stage_table(counted, "sizes")
    cells = stage_table(counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_words")), "cells")
    targets = stage_table(source_targets(cells.groupBy(*group[:2]).agg(F.sum("_words").alias("_source_size")), weights, most_copies), "targets")
    offsets = stage_table(cell_offsets(cells, group, keys[3:]).drop("_n", "_words"), "offsets")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(size, "_order", id_col))
    with_rank = lambda rows: rows.withColumn("_rank", rank).join(offsets, keys).withColumn("_k", F.col("_rank") + F.col("_offset"))
    ranked = stage_table(with_rank(counted).select(*group, "_k", size, id_col), "ranks")
    octaves = [r["_octave"] for r in cells.select("_octave").distinct().collect()] or [1]  # 64 at most
    rates = stage_table(octave_rates(ranked, targets, octaves, most_copies, seed).join(targets, group[:2]).coalesce(8), "rates")
    rows = with_rank(keyed(df.withColumn(size, n_words(F.col(text_col))))) if carry else ranked
    done = rows.join(rates, group).withColumn("_copies", _crossed(F.col("_place"), F.col("_rate"), F.col("_k"), most_copies))
    kept = restored(df, own) if carry else [F.col(id_col).alias(own[0])]
    return done.select(*kept, *[F.col(c).alias(n) for c, n in zip((size, "_source_size", "_target", "_copies"), out_names, strict=True)])


def emit_copies(mixed: DataFrame, columns: list[str], copies: str = "copies") -> DataFrame:
    """The mix itself: each row as often as it was taken."""
    times = F.explode(F.when(F.col(copies) > 0, F.sequence(F.lit(1), F.col(copies))))
    return mixed.select(*[F.col(f"`{c}`") for c in columns], times.alias("_copy")).drop("_copy")


def op4_systematic_mix(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, with the words the mix takes of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return systematic_mix(docs, carry=False).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _md5_sql(salt: str, *values: str) -> str:
    text = " || chr(31) || ".join([f"'{salt}'", *[f"coalesce(({v})::VARCHAR, chr(0))" for v in values]])
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def _octave_sql(octave: int) -> str:
    """A round of the SQL: expected copies in an octave, and what is wanted after it."""
    return f"""r{octave} AS MATERIALIZED (
  SELECT nul, src, place, wanted, ahead, greatest(0.0::DOUBLE, least(3.0::DOUBLE, CASE WHEN ahead > 0 THEN wanted / ahead ELSE 0.0::DOUBLE END)) AS rate FROM s{octave}),
t{octave} AS MATERIALIZED (
  SELECT nul, src, count(*) AS n, sum(size)::BIGINT AS words, sum(size * least(3, floor(place + rate * k) - floor(place + rate * (k - 1)))::BIGINT)::BIGINT AS taken
  FROM ranked JOIN r{octave} USING (nul, src) WHERE octave = {octave} GROUP BY nul, src),
s{octave - 1} AS MATERIALIZED (
  SELECT nul, src, place + coalesce(n, 0) * rate AS place, wanted - coalesce(taken, 0) AS wanted, ahead - coalesce(words, 0) AS ahead FROM r{octave} LEFT JOIN t{octave} USING (nul, src)),
"""


_TOP = 24  # texts of fewer than 16 million words

OP4_SQL = f"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS nul, coalesce(source, '') AS src, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
keyed AS (SELECT *, {_md5_sql('mix', 'doc_id')} AS ord, length(bin(size)) AS octave FROM sized),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY nul, src, octave ORDER BY size, ord, doc_id) AS k FROM keyed),
sources AS (
  SELECT nul, src, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY nul, src) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY nul, src),
ordered AS (
  SELECT *, sum(source_size) OVER () AS total,
    row_number() OVER (ORDER BY source_size / w, nul, src) AS n,
    coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, nul, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY source_size / w, nul, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM sources),
share AS (SELECT min_by((total - capped)::DOUBLE / open_w, n) FILTER (WHERE 3 * source_size > (total - capped)::DOUBLE / open_w * w) AS per_weight FROM ordered),
targets AS MATERIALIZED (SELECT nul, src, source_size, least((3 * source_size)::DOUBLE, coalesce(per_weight, 0) * w) AS target FROM sources, share),
s{_TOP} AS MATERIALIZED (
  SELECT nul, src, {_md5_sql('mix', "CASE WHEN nul THEN 'true' ELSE 'false' END", 'src')} / 4294967296.0::DOUBLE AS place, target AS wanted, source_size AS ahead FROM targets),
{"".join(map(_octave_sql, range(_TOP, 0, -1)))}
rates AS ({" UNION ALL ".join(f"SELECT nul, src, {o} AS octave, place, rate FROM r{o}" for o in range(_TOP, 0, -1))})
SELECT doc_id, size, source_size, target, size * least(3, floor(place + rate * k) - floor(place + rate * (k - 1)))::BIGINT AS taken
FROM ranked JOIN rates USING (nul, src, octave) JOIN targets USING (nul, src)
"""
