"""Sharding by histogram sort: probes of exact byte counts are refined until the splitters meet a tolerance; then one exchange.

Every document gets a 63-bit key: 43 bits of its text's hash, then 20 bits of its id's hash. Equal texts are thus
neighbours, and a hot text can still be split anywhere inside. One aggregation counts the exact bytes and rows of
4096 equal key ranges; each range in which a wanted splitter falls too far from both edges is cut into 4096 again,
at most five times. Only counts of key ranges ever reach the driver: at most 4096 a splitter and some 10,000 more for
ranges with hot texts, whatever the input.

Law: ``bytes``. Splitters stand between groups of equal texts where that keeps each shard's end within
``tolerance`` of its target, and inside a group only where they must.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, positional, restored, stage_table, text_size

#: Key bits, those of them that tell documents of one text apart, and those that a pass tells apart.
KEY_BITS, ID_BITS, PROBE_BITS = 63, 20, 12
TOP_SHIFT = KEY_BITS - PROBE_BITS


def _key(text, ident):
    hashed = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()), 64 - (KEY_BITS - ID_BITS))
    return F.shiftleft(hashed, ID_BITS).bitwiseOR(F.xxhash64(ident).bitwiseAND(F.lit((1 << ID_BITS) - 1)))


def _count(keyed: DataFrame, ranges: list[tuple[int, int, int, bool]], most_rows: int, run_rows: int) -> list[dict[int, tuple[int, int, int]]]:
    """Bytes, rows and number of parts of each run of parts of each range (low, log2 of a part's width, parts, whether all parts are wanted): one pass, counts only to the driver.

    A key finds its range by its leading bits, which no range reaches over, and then among the few ranges that have these. Where only large parts are wanted, each of over ``most_rows`` rows is a
    run of its own; others are joined into runs of about ``run_rows``.
    """
    by_top: dict[int, list[tuple[int, int, int, int, bool]]] = {}
    for j, (low, shift, parts, every) in enumerate(ranges):
        by_top.setdefault(low >> TOP_SHIFT, []).append((low, low + (parts << shift) - 1, shift, j, every))
    table = keyed.sparkSession.createDataFrame(list(by_top.items()), "_top long, _ranges array<struct<low:long,last:long,shift:int,j:int,every:boolean>>")
    inside = F.filter("_ranges", lambda r: (r["low"] <= F.col("_key")) & (F.col("_key") <= r["last"]))
    found = keyed.withColumn("_top", F.shiftright("_key", TOP_SHIFT)).join(F.broadcast(table), "_top").withColumn("r", F.try_element_at(inside, F.lit(1))).where("r is not null")
    counts = found.select("r.j", "r.every", F.expr("shiftright(_key - r.low, r.shift)").alias("p"), "_size").groupBy("j", "every", "p").agg(F.sum("_size").alias("b"), F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("j").orderBy("p")  # 4096 rows at most
    alone = F.col("every") | (F.col("n") > most_rows)
    counts = counts.withColumns({"alone": alone, "own": F.sum(alone.cast("long")).over(along), "low": F.when(~alone, F.floor((F.sum("n").over(along) - F.col("n")) / run_rows))})
    runs = counts.groupBy("j", "own", "alone", "low").agg(F.min("p").alias("p"), F.sum("b").alias("b"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    out: list[dict[int, tuple[int, int, int]]] = [{} for _ in ranges]
    for r in runs.collect():
        out[r["j"]][r["p"]] = (r["b"], r["n"], r["k"] if not r["alone"] else 1)
    return out


def refine_splitters(keyed: DataFrame, shards: int, tolerance: float, probe_bits: int = PROBE_BITS, most_rows: int | None = None):
    """Splitters (``shards - 1`` keys; a shard starts at its splitter) and the key ranges known so far with exact rows.

    Returns (splitters, ranges) where ranges is a sorted list of (low key, rows), gapless over the whole key space.
    A range of more than ``most_rows`` rows is refined too, so that no later task gets a hot text whole; of its parts only the large ones are told apart.
    """
    shift = KEY_BITS - probe_bits
    first = keyed.groupBy(F.shiftright("_key", shift).alias("p")).agg(F.sum("_size").alias("b"), F.count(F.lit(1)).alias("n")).collect()  # 2 ** probe_bits rows at most
    found = {r["p"]: (r["b"], r["n"]) for r in first}
    # low key -> [log2 width, or 0 where it is not to be cut, bytes, rows]
    known = {p << shift: [shift, *found.get(p, (0, 0))] for p in range(1 << probe_bits)}
    total, rows = sum(v[1] for v in known.values()), sum(v[2] for v in known.values())
    slack = max(1.0, tolerance * total / shards)
    most_rows, run_rows = most_rows or max(64, rows // 512), max(16, rows >> 12)
    splitters: list[int] = [0] * (shards - 1)
    while True:
        wanted, at = set(), 0
        lows = sorted(known)
        ends, below = [], 0
        for low in lows:
            below += known[low][1]
            ends.append(below)
        for j in range(1, shards):
            goal = total * j / shards
            while at < len(lows) - 1 and ends[at] < goal:
                at += 1
            low = lows[at]
            sh, b, n = known[low]
            left, right = goal - (ends[at] - b), ends[at] - goal
            splitters[j - 1] = low if left <= right else lows[at + 1] if at + 1 < len(lows) else 1 << KEY_BITS
            aligned = sh >= ID_BITS  # its edges stand between groups of equal texts
            if min(left, right) > (slack if aligned else max(1.0, slack / 4)) and n > 1 and sh > 0:
                wanted.add(low)
        active = wanted | {low for low, (sh, _, n) in known.items() if n > most_rows and sh > 0}
        if not active:
            break
        todo = []
        for low in sorted(active):
            sh = known[low][0]
            step = min(probe_bits, sh - ID_BITS if sh > ID_BITS else sh)  # stops at the edges of groups first
            todo.append((low, sh - step, 1 << step, low in wanted))
        for (low, sh, parts, every), found in zip(todo, _count(keyed, todo, most_rows, run_rows), strict=True):
            known.pop(low)
            edge = low
            for p in sorted(found):  # empty parts before a run are a range of their own
                here, (b, n, k) = low + (p << sh), found[p]
                if edge < here:
                    known[edge] = [0, 0, 0]
                known[here] = [sh if k == 1 else 0, b, n]
                edge = here + (1 << sh) if every or k == 1 else low + (parts << sh)
            if edge < low + (parts << sh):
                known[edge] = [0, 0, 0]
    ranges = [(low, known[low][2]) for low in sorted(known)]
    return [min(s, (1 << KEY_BITS) - 1) if s >= 1 << KEY_BITS else s for s in splitters], ranges


def _cells(splitters: list[int], ranges: list[tuple[int, int]], wanted: int) -> list[tuple[int, int, int, int]]:
    """Neighbouring ranges joined into about ``wanted`` cells, never over a splitter: (low, shard, first slot, cell)."""
    rows = sum(n for _, n in ranges)
    most, cuts = max(1, rows // wanted), sorted(splitters)
    out, shard, slot, held, at = [], 0, 0, 0, 0
    for low, n in ranges:
        new = not out
        while at < len(cuts) and cuts[at] <= low:
            at, shard, slot, new = at + 1, shard + 1, 0, True
        if new or held + n > most:
            out.append((low, shard, slot, len(out)))
            held = 0
        held, slot = held + n, slot + n
    return out


def histogram_sort(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, tolerance: float = 0.01, cells: int | None = None) -> DataFrame:
    """All rows of ``df`` with ``shard`` and ``slot`` (gapless from 0 within a shard), in key order, plus ``size`` and ``text_crc32``.

    A null text has size 1 and the digest of no bytes, as an empty one has, but is a group of its own. A null id is a
    value as any other. Equal rows may swap slots, which leaves the result as it is. An empty input gives no rows.
    ``df``'s own columns stay; where their names clash with the new ones, these get leading underscores.
    """
    own, names = df.columns, fresh(df, "size", "text_crc32", "shard", "slot")
    df, id_col, text_col = positional(df, id_col, text_col)
    size, crc, shard, slot, key, cell, first, lows, top = "_size", "_crc", "_shard", "_slot", "_key", "_cell", "_first", "_lows", "_top"
    text = F.col(text_col)
    keyed = df.withColumns({key: _key(text, F.col(id_col)), size: text_size(text), crc: F.crc32(F.coalesce(text, F.lit("")).cast("binary"))})
    narrow = stage_table(keyed.select(F.col(key).alias("_key"), F.col(size).alias("_size")), "keys")
    splitters, ranges = refine_splitters(narrow, shards, tolerance)
    # A cell is a task's sort: about half a million rows at most, in 2048 cells at least.
    found = _cells(splitters, ranges, cells or max(2048, sum(n for _, n in ranges) // 500_000))
    # Cells by the key's leading bits: 4096 rows and a few more for each refined range, so the broadcast is bounded.
    bits, by_top, last = 12, {}, None
    starts = {low: (low, s, f, c) for low, s, f, c in found}
    ordered, i = sorted(starts), 0
    for t in range(1 << bits):
        begin, end = t << (KEY_BITS - bits), (t + 1) << (KEY_BITS - bits)
        inside = []
        while i < len(ordered) and ordered[i] < end:
            inside.append(starts[ordered[i]])
            i += 1
        if last is not None and not (inside and inside[0][0] == begin):
            inside = [(begin, *last[1:]), *inside]
        by_top[t] = inside
        last = inside[-1] if inside else last
    spark = df.sparkSession
    table = spark.createDataFrame([(t, v) for t, v in by_top.items()], f"{top} long, {lows} array<struct<low:long,shard:int,first:long,cell:int>>")
    at = F.element_at(F.filter(F.col(lows), lambda x: x["low"] <= F.col(key)), -1)
    placed = keyed.withColumn(top, F.shiftright(F.col(key), KEY_BITS - bits)).join(F.broadcast(table), top).withColumn(cell, at)
    placed = placed.withColumns({shard: F.col(f"{cell}.shard"), first: F.col(f"{cell}.first"), cell: F.col(f"{cell}.cell")}).drop(lows, top)
    order = Window.partitionBy(cell).orderBy(key, id_col, crc)
    placed = placed.withColumn(slot, (F.col(first) + F.row_number().over(order) - 1).cast("long"))
    return placed.select(*restored(placed, own), *[F.col(c).alias(n) for c, n in zip((size, crc, shard, slot), names, strict=True)])


def op3_histogram_sort(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in 16 shards of near-equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return histogram_sort(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
