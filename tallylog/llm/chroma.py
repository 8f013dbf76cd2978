"""Chroma fingerprints of audio, and recordings aligned by them.

Sound is cut into overlapping frames; each frame's spectrum is folded into 12 pitch classes, smoothed over time and normalised. Over this image (time by
pitch class) an integral image gives any rectangle's sum in four look-ups, so that 16 filters (sums of one rectangle against another) are applied to each
position at once. Each response is cut into four levels, in Gray code, by the quartiles over all positions of all recordings: 32 bits a position.

To align two recordings, positions with equal integers vote for their offset; the offset with most votes is judged by the bits that differ over the overlap.
Recordings with equal fingerprints are one class, and classes are aligned, not recordings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

RATE, FRAME, HOP = 11025, 4096, 1365
LOW_HZ, HIGH_HZ = 55.0, 3520.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: Filters: kind, first pitch class, pitch classes, positions wide. Kinds: 0 all; 1 upper against lower half; 2 earlier against later; 3 quarters crosswise; 4 middle third in pitch against the rest; 5 the same in time.
FILTERS = [
    (0, 0, 3, 12), (0, 4, 4, 6), (0, 8, 4, 9), (1, 0, 4, 12), (1, 4, 8, 6), (1, 2, 10, 9), (2, 0, 6, 8), (2, 6, 6, 12),
    (2, 0, 12, 4), (3, 0, 6, 12), (3, 4, 8, 8), (3, 6, 6, 4), (4, 0, 12, 10), (4, 3, 9, 5), (5, 0, 9, 12), (5, 5, 7, 9),
]
WIDEST = max(w for *_, w in FILTERS)
#: Recordings of one integer that meet the queries in one lot.
LOT = 10_000
MIN_VOTES, MIN_OVERLAP, MAX_ERROR = 2, 6, 0.25


def chroma(pcm: np.ndarray, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """(frames, 12), each of length 1 or all zero. Sound shorter than a frame has none."""
    n = (len(pcm) - frame) // hop + 1
    if n <= 0:
        return np.zeros((0, 12))
    freq = np.fft.rfftfreq(frame, 1 / rate)
    use = (freq >= LOW_HZ) & (freq <= min(HIGH_HZ, rate / 2))
    fold = np.zeros((int(use.sum()), 12), dtype=np.float32)
    fold[np.arange(len(fold)), np.round(12 * np.log2(freq[use] / 440.0)).astype(int) % 12] = 1
    hann = np.hanning(frame).astype(np.float32)
    out = []
    for low in range(0, n, 64):
        at = np.arange(low, min(n, low + 64))[:, None] * hop + np.arange(frame)[None, :]
        out.append((np.abs(np.fft.rfft(pcm[at].astype(np.float32) * hann, axis=1)[:, use]) ** 2) @ fold)
    image = np.concatenate(out).astype(np.float64)
    m = len(SMOOTH)
    if len(image) < m:
        return np.zeros((0, 12))
    image = sum(SMOOTH[i] * image[i : len(image) - m + 1 + i] for i in range(m))
    norm = np.sqrt((image**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-6, image / np.maximum(norm, 1e-6), 0)


def responses(image: np.ndarray) -> np.ndarray:
    """(positions, 16) filter responses, by an integral image: log ratios of the two areas of each filter."""
    n = len(image) - WIDEST + 1
    if n <= 0:
        return np.zeros((0, len(FILTERS)))
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(x0, x1, y0, y1):
        return total[t + x1, y1] - total[t + x0, y1] - total[t + x1, y0] + total[t + x0, y0]

    out = np.zeros((n, len(FILTERS)))
    for i, (kind, y, h, w) in enumerate(FILTERS):
        everything, h2, w2, h3, w3 = area(0, w, y, y + h), h // 2, w // 2, h // 3, w // 3
        if kind == 0:
            a, b = everything, np.zeros(n)
        elif kind == 1:
            a = area(0, w, y + h2, y + h)
            b = everything - a
        elif kind == 2:
            a = area(0, w2, y, y + h)
            b = everything - a
        elif kind == 3:
            a = area(0, w2, y, y + h2) + area(w2, w, y + h2, y + h)
            b = everything - a
        elif kind == 4:
            a = area(0, w, y + h3, y + 2 * h3)
            b = everything - a
        else:
            a = area(w3, 2 * w3, y, y + h)
            b = everything - a
        out[:, i] = np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0)))
    return out


def integers(values: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Two bits of Gray code a filter; ``levels`` (16, 3)."""
    level = (values[:, :, None] > levels[None]).sum(axis=2)
    gray = np.array([0, 1, 3, 2], dtype=np.uint64)[level]
    return (gray << (2 * np.arange(len(FILTERS), dtype=np.uint64))[None, :]).sum(axis=1, dtype=np.uint64).astype(np.uint32).view(np.int32)


def decode(data: bytes | None) -> np.ndarray:
    """16-bit little-endian mono samples; a last odd byte is left out, null is silence of no length."""
    return np.frombuffer((data or b"")[: len(data or b"") // 2 * 2], dtype="<i2").astype(np.float32)


def fit_levels(samples: list[bytes], rate: int = RATE) -> np.ndarray:
    """Quartiles of each filter's responses; zeros where there is nothing to learn from."""
    got = [r for s in samples if len(r := responses(chroma(decode(s), rate)))]
    return np.quantile(np.concatenate(got), [0.25, 0.5, 0.75], axis=0).T if got else np.zeros((len(FILTERS), 3))


def fingerprints(df: DataFrame, id_col: str, pcm_col: str, levels: np.ndarray, rate: int = RATE, read: Callable[[object], np.ndarray] = decode) -> DataFrame:
    """(id, prints array<int>): empty for null and for sound that is too short. ``read`` makes samples of a value of the column, one recording at a time, so that decoded sound is never held in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "prints": [integers(responses(chroma(read(b), rate)), levels) for b in pdf["pcm"]]})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(pcm_col).alias("pcm")).mapInPandas(run, f"id {kind}, prints array<int>")


def response_rows(df: DataFrame, id_col: str, pcm_col: str, rate: int = RATE, read: Callable[[object], np.ndarray] = decode) -> DataFrame:
    """(id, responses): each recording's filter responses as single-precision numbers, position by position."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "responses": [(responses(chroma(read(b), rate)) + 0.0).astype("<f4").tobytes() for b in pdf["pcm"]]})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(pcm_col).alias("pcm")).mapInPandas(run, f"id {kind}, responses binary")


def _sortable(data: bytes) -> np.ndarray:
    """(positions, 16) integers in the order of the responses."""
    bits = np.frombuffer(data, "<u4").reshape(-1, len(FILTERS))
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))


def _value(key: int) -> float:
    bits = np.uint32(key & 0x7FFFFFFF if key >> 31 else ~key & 0xFFFFFFFF)
    return float(bits.view(np.float32))


def _histogram(rows: DataFrame, highs: dict[int, list[int]] | None = None) -> DataFrame:
    """(filter, high, place, n): how many responses have which upper 16 bits; with ``highs``, which lower ones among those of these upper bits. No task holds more than the counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = [(f, h) for f in range(len(FILTERS)) for h in ([0] if highs is None else highs[f])]
        counts = {w: np.zeros(1 << 16, np.int64) for w in wanted}
        for pdf in batches:
            if not len(pdf):
                continue
            keys = _sortable(b"".join(pdf["responses"]))
            for f, h in wanted:
                own = keys[:, f]
                counts[f, h] += np.bincount(own >> 16 if highs is None else own[own >> 16 == h] & 0xFFFF, minlength=1 << 16)
        for (f, h), n in counts.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"filter": f, "high": h, "place": at, "n": n[at]})

    found = rows.select("responses").mapInPandas(run, "filter int, high int, place int, n long")
    return found.groupBy("filter", "high", "place").agg(F.sum("n").alias("n"))


def _at_ranks(counts: DataFrame, ranks: list[tuple[int, int, int]]) -> dict[tuple[int, int, int], tuple[int, int]]:
    """For each (filter, high, rank) the place that holds this rank, from 0, and the rank among those of the place."""
    along = Window.partitionBy("filter", "high").orderBy("place")  # 65,536 rows at most
    ends = counts.withColumn("end", F.sum("n").over(along))
    wanted = F.broadcast(counts.sparkSession.createDataFrame(sorted(set(ranks)), "filter int, high int, rank long"))
    found = ends.join(wanted, ["filter", "high"]).where((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("n")))
    return {(r["filter"], r["high"], r["rank"]): (r["place"], r["rank"] - r["end"] + r["n"]) for r in found.collect()}


def exact_levels(rows: DataFrame) -> np.ndarray:
    """Quartiles of each filter over all responses of ``rows`` (see ``response_rows``), which are read twice: by counts of their upper bits, then of the lower ones where a quartile lies. Zeros where there are none."""
    n = rows.agg(F.sum(F.octet_length("responses"))).first()[0] or 0
    n //= 4 * len(FILTERS)
    if not n:
        return np.zeros((len(FILTERS), 3))
    places = [(n - 1) * q / 4 for q in (1, 2, 3)]
    ranks = sorted({r for p in places for r in (int(p), min(int(p) + 1, n - 1))})
    filters = range(len(FILTERS))
    upper = _at_ranks(_histogram(rows), [(f, 0, r) for f in filters for r in ranks])
    highs = {f: sorted({upper[f, 0, r][0] for r in ranks}) for f in filters}
    lower = _at_ranks(_histogram(rows, highs), [(f, *upper[f, 0, r]) for f in filters for r in ranks])

    def value(f: int, r: int) -> float:
        high, rest = upper[f, 0, r]
        return _value((high << 16) + lower[f, high, rest][0])

    return np.array([[value(f, int(p)) + (value(f, min(int(p) + 1, n - 1)) - value(f, int(p))) * (p - int(p)) for p in places] for f in filters])


def prints_of(rows: DataFrame, levels: np.ndarray) -> DataFrame:
    """(id, prints) of response rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "prints": [integers(np.frombuffer(b, "<f4").reshape(-1, len(FILTERS)).astype(np.float64), levels) for b in pdf["responses"]]})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, prints array<int>")


def bit_error(a: Column, b: Column, offset: Column) -> tuple[Column, Column]:
    """(overlap, share of its bits that differ) of two arrays of integers, b's position being a's plus the offset."""
    start_a, start_b = F.greatest(F.lit(0), -offset), F.greatest(F.lit(0), offset)
    overlap = F.least(F.size(a) - start_a, F.size(b) - start_b)
    wrong = F.aggregate(F.zip_with(F.slice(a, start_a + 1, F.greatest(overlap, F.lit(0))), F.slice(b, start_b + 1, F.greatest(overlap, F.lit(0))), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return overlap, wrong / (32.0 * overlap)


def align(prints: DataFrame, queries: Column) -> DataFrame:
    """One row per recording of ``prints`` (id, prints): (id, n_prints, class_id, n_links, best_query_id, offset, bit_error).

    Queries are the ids for which ``queries`` holds. ``class_id`` is the least id with the same prints (its own for none). ``n_links`` counts the other query recordings that
    align: at least ``MIN_OVERLAP`` positions of which at most ``MAX_ERROR`` of the bits differ, at the offset with most votes (ties to the nearest to 0, then the lesser), which has
    ``MIN_VOTES`` at least. The best has the fewest errors, then the longest overlap, then the least id; nulls where there is none. Recordings without prints
    align with none. Null ids are recordings as any others, but no queries. A repeated row counts as a recording of its own, and as the query itself. Empty input: no rows.
    """
    rows = stage_table(prints.withColumns({"key": F.md5(F.array_join("prints", ",").cast("binary")), "is_query": F.coalesce(queries, F.lit(False))}), "prints")
    some = rows.where(F.size("prints") > 0)
    firsts = some.where("is_query").groupBy("key").agg(F.min("id").alias("q1"), F.countDistinct("id").alias("nq"))
    seconds = some.where("is_query").join(firsts.select("key", "q1"), "key").where("id > q1").groupBy("key").agg(F.min("id").alias("q2"))
    classes = some.groupBy("key").agg(F.min("id").alias("class_id"), F.first("prints").alias("prints"))
    classes = stage_table(classes.join(firsts, "key", "left").join(seconds, "key", "left"), "classes")
    each = lambda df, key: df.select(F.col("key").alias(key), F.posexplode("prints").alias("pos", "v"))
    left, right = each(classes.where("nq is not null"), "qk"), each(classes, "rk")
    # Each integer's positions in a class are one row, so that steady sounds don't multiply.
    left = left.groupBy("v", "qk").agg(F.collect_list("pos").alias("qpos"))
    right = right.groupBy("v", "rk").agg(F.collect_list("pos").alias("rpos"))
    # An integer that many recordings have is dealt over lots of these; the queries go to each lot.
    lots = stage_table(right.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / LOT).cast("int").alias("lots")), "lots")
    right = right.join(lots, "v").withColumn("lot", F.pmod(F.xxhash64("rk"), F.col("lots")).cast("int")).drop("lots")
    left = left.join(lots, "v").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
    votes = left.join(right, ["v", "lot"]).where("qk != rk").select("qk", "rk", F.explode(F.flatten(F.transform("qpos", lambda q: F.transform("rpos", lambda r: r - q)))).alias("offset"))
    votes = votes.groupBy("qk", "rk", "offset").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("qk", "rk").agg(F.max(F.struct("n", (-F.abs("offset")).alias("near"), (-F.col("offset")).alias("low"))).alias("best")).where(F.col("best.n") >= MIN_VOTES)
    best = best.select("qk", "rk", (-F.col("best.low")).alias("offset"))
    found = best.join(classes.select(F.col("key").alias("qk"), F.col("prints").alias("a"), "q1", "nq"), "qk").join(classes.select(F.col("key").alias("rk"), F.col("prints").alias("b")), "rk")
    overlap, error = bit_error(F.col("a"), F.col("b"), F.col("offset"))
    found = found.withColumns({"overlap": overlap, "error": error}).where(F.col("overlap") >= MIN_OVERLAP).where(F.col("error") <= MAX_ERROR)
    near = found.groupBy("rk").agg(F.sum("nq").alias("links"), F.min(F.struct("error", (-F.col("overlap")).alias("o"), "q1", "offset")).alias("best"))
    known = classes.select("key", "class_id", "q1", "q2", "nq").join(near.withColumnRenamed("rk", "key"), "key", "left")
    out = rows.select("id", "key", "is_query", F.size("prints").alias("n_prints")).join(known, "key", "left")
    twin = F.when(F.col("is_query") & (F.col("q1") == F.col("id")), F.col("q2")).otherwise(F.col("q1"))
    has = F.col("n_prints") > 0
    links = F.coalesce("nq", F.lit(0)) - F.when(F.col("is_query") & has, 1).otherwise(0) + F.coalesce("links", F.lit(0))
    out = out.withColumn("twin", F.when(has, twin))
    return out.select(
        "id", "n_prints", F.coalesce("class_id", "id").alias("class_id"), F.when(has, links).otherwise(0).cast("long").alias("n_links"), F.coalesce("twin", F.col("best.q1")).alias("best_query_id"),
        F.when(F.col("twin").isNotNull(), 0).otherwise(F.col("best.offset")).cast("int").alias("offset"), F.when(F.col("twin").isNotNull(), 0.0).otherwise(F.col("best.error")).alias("bit_error"))


def sonify(vectors: list, rate: int = RATE, note: float = 0.06) -> list[bytes | None]:
    """A recording for each vector: a note for each component, its pitch (of two octaves from A3 on) and loudness by the value. None for no vector or one that isn't finite."""
    size = int(rate * note)
    fade = np.minimum(1, np.minimum(np.arange(size), np.arange(size)[::-1]) / (0.1 * size))
    waves = np.sin(2 * np.pi * (220 * 2 ** (np.arange(25) / 12))[:, None] * np.arange(size)[None, :] / rate) * fade
    out = []
    for v in vectors:
        x = np.array([np.nan if c is None else c for c in v], dtype=np.float64) if v is not None else np.zeros(0)
        if not len(x) or not np.isfinite(x).all():
            out.append(None)
            continue
        pitch = np.clip(np.round(12 + 40 * x), 0, 24).astype(int)
        out.append((waves[pitch] * (6000 + 16000 * np.minimum(1, np.abs(x)))[:, None]).astype("<i2").tobytes())
    return out


def op1_chroma_alignment(spark, sf_dir: str) -> DataFrame:
    """The recordings that the vectors of ``embeddings`` sound as, aligned with every fiftieth of them."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    heard = stage_table(response_rows(rows, "vec_id", "embedding", read=lambda v: decode(sonify([v])[0])), "responses")
    return align(prints_of(heard, exact_levels(heard)), F.col("id") % 50 == 0).withColumnRenamed("id", "vec_id")
