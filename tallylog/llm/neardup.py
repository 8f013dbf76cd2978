"""Near-duplicate join on word n-grams: MinHash banding finds candidates, full n-gram sets decide.

1. Each document's set of five-word runs is hashed; texts with equal sets (exact copies among them) fold into one class, the
   representative being the least id. From then on classes are joined, not documents.
2. ``choose_bands`` picks bands and rows so that a pair at the threshold meets in some band with the target recall. Classes are
   shuffled on their band hashes. In a bucket, 16-bit sketches of the MinHash values screen the pairs, and a spanning forest of
   the pairs that pass is all that leaves it. A bucket of over ``BLOCK`` classes is cut by size of set, so that only sets whose sizes
   allow a link meet, and each of these strips into blocks; each pair of blocks is a task of its own: no pair that can link is left out, and no bucket is held whole.
   What links a block's own rows comes from its own task only; two blocks give an edge for each two of their parts that meet, so that edges grow with a group, not with its square.
3. The forests' components hold every candidate pair. Their members' full sets are compared, block by block as well (blocks are bounded by n-grams, too); the
   counts of links and a spanning forest of the verified pairs come back. So every link is found. A class of a strip of n classes is sent to n / ``BLOCK`` tasks:
   where n different texts are near copies, each of their links is counted, and that is work of order n squared.
4. The verified components are the groups of near-duplicates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, give_back, positional, restored, stage_table
from .components import connected_components
from .shingles import byte_slices, mix, new_key, shingle_sets

N_GRAM, THRESHOLD, RECALL = 5, 0.8, 0.99999
#: Classes of a bucket, or members of a candidate group, that meet in one task.
BLOCK = 512
#: N-grams of all sets in a block; a longer set is a block of its own.
BLOCK_GRAMS = 2_000_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 192, low: float = 0.4) -> tuple[int, int]:
    """(bands, rows): of those that reach the recall at the threshold within ``most`` hash functions, the one with the fewest chance meetings at similarity ``low``."""
    best = None
    for rows in range(1, most + 1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                chance = 1 - (1 - low**rows) ** bands
                if best is None or chance < best[0]:
                    best = (chance, bands, rows)
                break
    if best is None:
        raise ValueError("no bands reach this recall")
    return best[1:]


def minhashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(texts, n) uint32 MinHash values; texts without n-grams get zeros."""
    out = np.zeros((len(sets), n), dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    h = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
    factors = (mix(np.arange(n, dtype=np.uint64), 5) >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for j in range(n):
            v = (h ^ factors[j]) * np.uint32(2 * (0x85EBCA6B * (j + 1) & 0x7FFFFFFF) + 1)
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            out[full, j] = np.minimum.reduceat(v, starts)
    return out


def describe(df: DataFrame, id_col: str, text_col: str, bands: int, rows: int, k: int = N_GRAM, key: int = 0) -> DataFrame:
    """(id, t, n, h1, h2, bands, sketch) of each row: a hash of its text, size and 128-bit digest of its set, a hash per band, 16 bits per MinHash value."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for low, high, texts in byte_slices(batch.column(1)):
                sets = shingle_sets(texts, k, key)
                with np.errstate(over="ignore"):
                    digests = [np.array([mix(s, salt).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64) for salt in (11, 12)]
                values = minhashes(sets, bands * rows)
                keys = np.zeros((len(sets), bands), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        keys = mix(keys ^ values[:, r::rows][:, :bands].astype(np.uint64), 20 + r)
                    keys = mix(keys, 3) ^ mix(np.arange(bands, dtype=np.uint64), 4)[None, :]
                sketch = (values & np.uint32(0xFFFF)).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), pa.array([len(s) for s in sets], pa.int32()), pa.array(digests[0]), pa.array(digests[1]),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(sets) + 1, bands, dtype=np.int32)), pa.array(keys.view(np.int64).ravel())), pa.array([s.tobytes() for s in sketch], pa.binary())],
                    ["id", "t", "n", "h1", "h2", "bands", "sketch"])
            del batch
            give_back()

    kind = df.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")
    return df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("t")).mapInArrow(run, f"id {kind}, t long, n int, h1 long, h2 long, bands array<long>, sketch binary")


def _forest(ok: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph whose pairs are marked above the diagonal. With ``side`` (two blocks), pairs of one side are those that the blocks' own tasks link: they hold
    together here without being edges, so that blocks that hang together give one edge, not one for each of their rows."""
    n, edges = len(ok), []
    if n == 2:
        return [(0, 1)] if ok[0, 1] and (side is None or side[0] != side[1]) else []
    part = np.arange(n)
    across = None if side is None else side[:, None] != side[None, :]
    for marked, new in ((ok, True),) if side is None else ((ok & ~across, False), (ok & across, True)):
        for i in range(n - 1):
            at = i + 1 + np.flatnonzero(marked[i, i + 1 :])
            at = at[part[at] != part[i]]
            if len(at):
                parts, first = np.unique(part[at], return_index=True)
                edges += [(i, int(j)) for j in at[first]] if new else []
                part[np.isin(part, parts)] = part[i]
    return edges


def _screen(sketches: np.ndarray, least: float) -> np.ndarray:
    """Marks, above the diagonal, of the pairs whose sketches agree in at least that share."""
    n, width = sketches.shape
    ok = np.zeros((n, n), dtype=bool)
    for i in range(n - 1):
        ok[i, i + 1 :] = (sketches[i + 1 :] == sketches[i]).sum(axis=1) >= least * width
    return ok


def _tasks(rows: DataFrame, key: str, weight: str, threshold: float, small: int) -> DataFrame:
    """``rows`` (key, rep, n and others) with ``_task``, ``_low`` and ``_same``. Keys of one block share tasks, in ``small`` lots. A larger key is cut into strips by size of set (n), so that
    links are possible within a strip and with its neighbours only, strips into blocks, and each row goes to every pair of blocks that has its own: ``_low`` tells which of
    the two that is, ``_same`` that they are one."""
    strip = F.floor(F.log(F.col("n").cast("double")) / math.log(1.01 / threshold)).cast("int")
    rows = rows.withColumn("_strip", strip)
    strips = rows.groupBy(key, "_strip").agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_w"))
    strips = strips.withColumn("_blocks", F.ceil(F.greatest(F.col("_n") / BLOCK, F.col("_w") / BLOCK_GRAMS)).cast("int"))
    keys = strips.groupBy(key).agg(F.sum("_n").alias("_size"), F.sum("_w").alias("_weight"), F.map_from_entries(F.collect_list(F.struct("_strip", "_blocks"))).alias("_of"))
    rows = rows.join(keys.withColumn("_big", (F.col("_size") > BLOCK) | (F.col("_weight") > BLOCK_GRAMS)).drop("_size", "_weight"), key)
    one = F.array(F.struct(F.concat(F.lit("s"), F.pmod(F.xxhash64(key), F.lit(small)).cast("string")).alias("task"), F.lit(True).alias("low"), F.lit(True).alias("same")))
    own, block = F.col("_strip"), F.pmod(F.xxhash64("rep", F.lit("block")), F.col("_of")[F.col("_strip")]).cast("int")

    def pair(other, theirs):
        low = (own < other) | ((own == other) & (block <= theirs))
        mine, yours = F.concat_ws(".", own.cast("string"), block.cast("string")), F.concat_ws(".", other.cast("string"), theirs.cast("string"))
        return F.struct(F.concat_ws("/", F.lit("x"), F.col(key).cast("string"), F.when(low, mine).otherwise(yours), F.when(low, yours).otherwise(mine)).alias("task"), low.alias("low"), (mine == yours).alias("same"))

    pairs = F.flatten(F.transform(F.filter(F.array(own - 1, own, own + 1), lambda o: F.array_contains(F.map_keys("_of"), o)), lambda o: F.transform(F.sequence(F.lit(0), F.col("_of")[o] - 1), lambda e: pair(o, e))))
    rows = rows.withColumn("_to", F.explode(F.when(F.col("_big"), pairs).otherwise(one)))
    return rows.withColumns({"_task": F.col("_to.task"), "_low": F.col("_to.low"), "_same": F.col("_to.same")}).drop("_to", "_of", "_big", "_strip")


def _candidates(reps: DataFrame, least: float, threshold: float) -> DataFrame:
    """Edges (a, b) of spanning forests over the candidate pairs."""
    # Alone in a bucket: most rows. They are found on narrow rows, before sketches are shuffled.
    narrow = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = narrow.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1").drop("_size")
    narrow = stage_table(narrow.join(shared, "bucket").withColumn("_one", F.lit(1)), "buckets")
    small = max(64, narrow.count() // 5000)
    rows = _tasks(narrow, "bucket", "_one", threshold, small).select("_task", "bucket", "_low", "_same", "rep")
    rows = rows.join(reps.select("rep", "sketch"), "rep")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        pdf = pdf.sort_values(["bucket", "rep"])
        cut = np.flatnonzero(np.diff(pdf["bucket"].to_numpy(), prepend=np.nan) != 0).tolist() + [len(pdf)]
        ids, sides, sketches, same = pdf["rep"].to_numpy(), pdf["_low"].to_numpy(), pdf["sketch"].tolist(), pdf["_same"].to_numpy()
        for low, high in zip(cut[:-1], cut[1:], strict=True):
            s = np.frombuffer(b"".join(sketches[low:high]), dtype="<u2").reshape(high - low, -1)
            for a, b in _forest(_screen(s, least), None if same[low] else sides[low:high]):
                out_a.append(ids[low + a])
                out_b.append(ids[low + b])
        return pd.DataFrame({"a": out_a, "b": out_b}).drop_duplicates()

    return rows.groupBy("_task").applyInPandas(link, "a long, b long").distinct()


def _verify(ids: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray | None, threshold: float):
    """Exact similarities of all pairs (between the sides, if given): (linked classes, linked documents, forest edges)."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.diff(flat, prepend=flat[0] ^ np.uint64(1)) != 0)
    spans = np.diff(starts, append=len(flat))
    common = np.zeros((n, n), dtype=np.float32)
    starts, spans = starts[spans > 1], spans[spans > 1]
    wide = spans > 6
    for k in np.unique(spans[~wide]):  # few documents share it: count its pairs
        at = owner[starts[spans == k][:, None] + np.arange(k)[None, :]]
        for x in range(k):
            for y in range(x + 1, k):
                np.add.at(common, (at[:, x], at[:, y]), 1)
    cols = np.flatnonzero(wide)
    for low in range(0, len(cols), 2048):  # many do: a product of indicator matrices
        part = cols[low : low + 2048]
        m = np.zeros((n, len(part)), dtype=np.float32)
        for j, c in enumerate(part):
            m[owner[starts[c] : starts[c] + spans[c]], j] = 1
        common += np.triu(m @ m.T, 1)
    union = sizes[:, None] + sizes[None, :] - common
    # In whole numbers: 0.8 is met exactly by 4 of 5.
    ok = np.triu(common * 1000 >= np.round(threshold * 1000) * union, 1)
    edges = _forest(ok, side)
    if side is not None:
        ok &= side[:, None] != side[None, :]
    both = ok | ok.T
    return both.sum(axis=1), both @ copies, edges


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, k: int = N_GRAM) -> DataFrame:
    """One row per row of ``df``: (id, ``class_id``, ``n_links``, ``n_text_links``).

    ``class_id`` is the least id of the group of near-duplicates (documents joined by links, however many lie between). ``n_links`` counts the other
    documents with similarity of at least ``threshold``, copies one by one; ``n_text_links`` the other n-gram sets. Similarity is the Jaccard
    coefficient of the sets of k-word runs (of all words together in texts of fewer than k). A text that is null or without words has no links and
    its own id as class, even beside others. A repeated row counts as a copy of the first. An empty input gives no rows.
    """
    bands, rows, key = *choose_bands(threshold, recall), new_key()
    docs = stage_table(describe(df, id_col, text_col, bands, rows, k, key), "sketches")
    worded = docs.where("n > 0")
    least_of = lambda: F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("least")
    reps = worded.groupBy("h1", "h2", "n").agg(least_of(), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # Classes have numbers of their own, fixed by being written: ids may be null, or stand for several texts.
    reps = stage_table(reps.withColumn("rep", F.monotonically_increasing_id()), "classes")
    # Sketches agree less or more than the sets by chance: five standard errors, and no more chance meetings than that needs.
    least = threshold - 5 * (threshold * (1 - threshold) / (bands * rows)) ** 0.5
    groups = connected_components(stage_table(_candidates(reps, least, threshold), "candidates"))
    members = groups.withColumnsRenamed({"node": "rep", "component": "part"}).join(reps.select("rep", "copies", "n", "h1", "least"), "rep")
    members = stage_table(members, "members")
    # The members grow with the input, so they aren't broadcast at any size. A class's text is its least row's, by id and hash of the text.
    text = F.col(f"`{text_col}`")
    own = [F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("t")).alias("least"), text.alias("text")]
    key_of = lambda c: [F.coalesce(F.col(f"{c}.id").cast("string"), F.lit("\x00")), F.col(f"{c}.t")]
    left = df.select(*own).select(*[c.alias(f"k{i}") for i, c in enumerate(key_of("least"))], "text")
    texts = left.join(members.select("rep", "part", "copies", "h1", *[c.alias(f"k{i}") for i, c in enumerate(key_of("least"))]).hint("merge"), ["k0", "k1"])

    def sets_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made, keep = [], []
            h1 = batch.column(4).to_pylist()
            for low, _, found in byte_slices(batch.column(1)):
                for i, s in enumerate(shingle_sets(found, k, key), low):
                    with np.errstate(over="ignore"):
                        if int(np.array(mix(s, 11).sum(dtype=np.uint64)).view(np.int64)) == h1[i]:  # else another text under the same id
                            keep.append(i)
                            made.append(s.tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), batch.column(3).take(at), pa.array(made, pa.binary())], ["rep", "part", "copies", "grams"])
            del batch
            give_back()

    grams = texts.select("rep", "text", "part", "copies", "h1").mapInArrow(sets_of, "rep long, part long, copies long, grams binary")
    held = members.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("grams")).first()
    lots = max(64, held["rows"] // 500, held["grams"] // BLOCK_GRAMS)  # of whole groups: bounded by their n-grams, however few members have them
    dealt = _tasks(members.select("rep", "part", "n"), "part", "n", threshold, lots).select("rep", "_task", "_low", "_same")
    tasks = grams.join(dealt.hint("merge"), "rep")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.drop_duplicates(["part", "rep"]).sort_values(["part", "rep"])
        for _, g in pdf.groupby("part", sort=False):
            if len(g) < 2:
                continue
            sets = [np.frombuffer(b, dtype=np.uint64) for b in g["grams"]]
            side = None if g["_same"].iloc[0] else g["_low"].to_numpy()
            ids = g["rep"].to_numpy()
            n, weight, edges = _verify(ids, sets, g["copies"].to_numpy(), side, threshold)
            out.append(pd.DataFrame({"rep": ids, "other": ids, "texts": n.astype(np.int64), "docs": weight.astype(np.int64)}))
            out.append(pd.DataFrame({"rep": [ids[a] for a, _ in edges], "other": [ids[b] for _, b in edges], "texts": 0, "docs": 0}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "other": [], "texts": [], "docs": []})

    verified = stage_table(tasks.groupBy("_task").applyInPandas(verify, "rep long, other long, texts long, docs long"), "links")
    linked = verified.groupBy("rep").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    merged = connected_components(verified.where("rep != other"), "rep", "other").withColumnRenamed("node", "rep")
    named = reps.select("rep", F.struct("least.none", "least.id").alias("least"))
    whole = merged.join(named, "rep").groupBy("component").agg(F.min("least").alias("whole"))
    classes = reps.select("h1", "h2", "n", "rep", "copies", "least").join(linked, "rep", "left").join(merged.join(whole, "component").drop("component"), "rep", "left")
    class_id = F.when(F.col("whole").isNotNull(), F.col("whole.id")).otherwise(F.col("least.id"))
    classes = classes.select("h1", "h2", "n", class_id.alias("class_id"), (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"))
    found = docs.select("id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"], "left")
    own = fresh(df.select(id_col), "class_id", "n_links", "n_text_links")
    return found.select(F.col("id").alias(id_col), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias(own[0]), F.coalesce("n_links", F.lit(0)).cast("long").alias(own[1]), F.coalesce("n_text_links", F.lit(0)).cast("long").alias(own[2]))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of near-duplicates: the one with the least id, and one of several rows of that id.

    Rows without words are copies of each other only where their ids are equal. Null ids: such rows are all kept.
    """
    own = df.columns
    df, id_col, text_col = positional(df, id_col, text_col)
    found = near_duplicates(df.where(F.col(id_col).isNotNull()), id_col, text_col)
    kept = found.where(F.col(id_col) == F.col("class_id")).select(F.col(id_col).alias("_keep")).distinct()
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))
    whole = df.join(kept, F.col(id_col) == F.col("_keep")).withColumn("_rank", F.row_number().over(first)).where("_rank = 1")
    whole = whole.select(*df.columns).unionByName(df.where(F.col(id_col).isNull()))
    return whole.select(*restored(whole, own))


def op10_minhash_join(spark, sf_dir: str) -> DataFrame:
    """Every document with its class of near-duplicates and its links."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP10_SQL = """
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') || '/' || len(w) ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM split, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM grams GROUP BY doc_id),
reps AS (SELECT h, min(doc_id) AS rep, count(*) AS copies, min(n) AS n FROM sets GROUP BY h),
rep_grams AS (SELECT doc_id AS rep, g FROM grams WHERE doc_id IN (SELECT rep FROM reps)),
common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM rep_grams a JOIN rep_grams b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL),
links AS (
  SELECT a, b, y.copies AS copies FROM common JOIN reps x ON x.rep = a JOIN reps y ON y.rep = b
  WHERE c * 10 >= 8 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_of AS (SELECT a AS rep, min(least(a, b)) AS class_id FROM reach GROUP BY a),
counted AS (SELECT a AS rep, count(*) AS texts, sum(copies) AS docs FROM links GROUP BY a)
SELECT d.doc_id, coalesce(l.class_id, r.rep, d.doc_id) AS class_id, coalesce(k.docs + r.copies - 1, r.copies - 1, 0)::BIGINT AS n_links, coalesce(k.texts, 0)::BIGINT AS n_text_links
FROM documents d LEFT JOIN sets s USING (doc_id) LEFT JOIN reps r ON r.h = s.h LEFT JOIN least_of l ON l.rep = r.rep LEFT JOIN counted k ON k.rep = r.rep
"""
