"""Nearest neighbours by anisotropic (score-aware) product quantisation, four-bit table scans and exact reranking.

For a query q, ``|q - x|`` is least where the inner product ``q.x - |x|^2 / 2`` is greatest. Vectors are cut into pairs of components, each coded by one of 16
centroids, that is in four bits. Codes and centroids minimise not the error but the error of high inner products: the part of the residual that
is parallel to the vector weighs ``eta`` times as much as the rest. Vectors are coded less the sample's mean, which distances don't see.

A scan adds one table entry for each two codes, which gives the distance to what a vector's codes stand for; the vector itself is no farther from that than its
residual is long. The best ``candidates`` of each batch are ranked by their true distance, in double precision, and so is every other row that could still be nearer than the
k-th of these by that bound: near-equal vectors that share their codes, distant groups and odd lengths cost time, not neighbours.

The codebook is fitted on a bounded sample (``SAMPLE`` vectors by a hash of the id, fewer where they are long); every vector is coded and scanned.
Queries come in blocks of about ``QUERY_BLOCK``, each of which is one pass over the vectors and their codes, made and written before the next one begins. No block, and nothing sent to the driver, grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

SAMPLE, SAMPLE_VALUES, QUERY_BLOCK, CENTROIDS, THRESHOLD = 16_384, 4_000_000, 4096, 16, 0.2


class AnisotropicCodec:
    def __init__(self, dim: int, threshold: float = THRESHOLD) -> None:
        self.dim, self.parts = dim, -(-dim // 2)
        self.eta = max(2.0, (dim - 1) * threshold**2 / (1 - threshold**2))
        self.centroids = np.zeros((self.parts, CENTROIDS, 2))
        self.mean = np.zeros(dim)

    def split(self, x: np.ndarray) -> np.ndarray:
        """(n, parts, 2), an odd last component beside a zero."""
        out = np.zeros((len(x), 2 * self.parts), dtype=np.float64)
        out[:, : self.dim] = x
        return out.reshape(len(x), self.parts, 2)

    def _unit(self, x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x**2).sum(axis=(1, 2), keepdims=True)), 1e-300)

    def encode(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes (n, parts) of split vectors: coordinate descent on the anisotropic loss, from the nearest centroids on."""
        u = self._unit(x)
        codes = np.stack([((x[:, m, None, :] - self.centroids[m][None]) ** 2).sum(-1).argmin(1) for m in range(self.parts)], axis=1)
        rows = np.arange(self.parts)[None, :]
        parallel = (u * (x - self.centroids[rows, codes])).sum(-1)  # of each part
        total = parallel.sum(1)
        for _ in range(passes):
            for m in range(self.parts):
                r = x[:, m, None, :] - self.centroids[m][None]
                along = (u[:, m, None, :] * r).sum(-1)
                loss = (r**2).sum(-1) + (self.eta - 1) * ((total - parallel[:, m])[:, None] + along) ** 2
                codes[:, m] = loss.argmin(1)
                new = along[np.arange(len(x)), codes[:, m]]
                total += new - parallel[:, m]
                parallel[:, m] = new
        return codes.astype(np.uint8)

    def fit(self, vectors: np.ndarray, rounds: int = 6, seed: int = 3) -> AnisotropicCodec:
        x = self.split(vectors)
        u, rng = self._unit(x), np.random.default_rng(seed)
        for m in range(self.parts):
            self.centroids[m] = x[rng.choice(len(x), CENTROIDS, replace=len(x) < CENTROIDS), m]
        for _ in range(rounds):
            codes = self.encode(x, 1)
            rows = np.arange(self.parts)[None, :]
            parallel = (u * (x - self.centroids[rows, codes])).sum(-1)
            total = parallel.sum(1)
            for m in range(self.parts):
                rest = total - parallel[:, m]
                for c in range(CENTROIDS):
                    at = codes[:, m] == c
                    if not at.any():
                        self.centroids[m, c] = x[rng.integers(len(x)), m]
                        continue
                    uc, xc = u[at, m], x[at, m]
                    left = at.sum() * np.eye(2) + (self.eta - 1) * uc.T @ uc
                    right = xc.sum(0) + (self.eta - 1) * ((rest[at] + (uc * xc).sum(1))[:, None] * uc).sum(0)
                    self.centroids[m, c] = np.linalg.solve(left, right)
        return self

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, ceil(parts / 2), 256): inner products for each two codes at once."""
        one = np.einsum("qmd,mcd->qmc", self.split(queries), self.centroids)
        if self.parts % 2:
            one = np.concatenate([one, np.zeros_like(one[:, :1])], axis=1)
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(queries), -1, 256)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """What codes (n, parts) stand for."""
        return self.centroids[np.arange(self.parts)[None, :], codes].reshape(len(codes), -1)[:, : self.dim]

    @staticmethod
    def packed(codes: np.ndarray) -> np.ndarray:
        """(ceil(parts / 2), n): two four-bit codes a byte."""
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
        return np.ascontiguousarray((codes[:, 0::2] * 16 + codes[:, 1::2]).T)


def first_copies(ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows, least ids first, each (id, vector) once and without those of a vector that ``most`` lesser ids have too: none of these can be among a query's nearest."""
    order = np.argsort(ids, kind="stable")
    seen: dict[bytes, tuple[int, int]] = {}  # of a vector: how many ids so far, and the last of them
    keep = []
    for i in order.tolist():
        key, own = vectors[i].tobytes(), int(ids[i])
        n, last = seen.get(key, (0, None))
        if n < most and own != last:
            seen[key] = n + 1, own
            keep.append(i)
    return np.array(keep, dtype=np.int64)


def nearest_ids(q: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest ids of each query, by query, distance and id; an id counts by its least distance alone."""
    order = np.lexsort((d, ids, q))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (q[order][1:] != q[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[fresh]
    order = order[np.lexsort((ids[order], d[order], q[order]))]
    place = np.arange(len(order))
    start = np.maximum.accumulate(np.where(np.diff(q[order], prepend=-1) != 0, place, 0))
    return order[place - start < k]


def best_rows(score: np.ndarray, ids: np.ndarray, candidates: int, distinct: bool) -> np.ndarray:
    """Places of the rows of best score that hold ``candidates`` ids; more rows than that where ids repeat."""
    if len(ids) <= candidates:
        return np.arange(len(ids))
    if distinct:
        return np.argpartition(-score, candidates - 1)[:candidates]
    order = np.argsort(-score, kind="stable")
    first = np.sort(np.unique(ids[order], return_index=True)[1])
    return order if len(first) <= candidates else order[: first[candidates]]


#: What sums of a few thousand products in double precision may be off by, relative to their terms.
ROUNDING = 1e-12


def search_batch(codec: AnisotropicCodec, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, k: int, candidates: int, within: np.ndarray | None = None):
    """(query place, id, distance) of the k nearest ids to each query in this batch: table scan, then exact distances of the best and of all that may be nearer. ``within``: distances of which no more are wanted."""
    keep = first_copies(ids, vectors, k + 1)
    ids, vectors = ids[keep], vectors[keep].astype(np.float64)
    distinct = len(np.unique(ids)) == len(ids)
    centred, back, moved = vectors - codec.mean, codec.decoded(codes[keep]), queries - codec.mean
    packed, length = codec.packed(codes[keep]), (back**2).sum(1)
    residual = np.sqrt(((centred - back) ** 2).sum(1))
    size, own = (centred**2).sum(1), (moved**2).sum(1)
    out_q, out_i, out_d = [], [], []

    def distances(q: int, at: np.ndarray) -> np.ndarray:
        return np.sqrt(((vectors[at] - queries[q]) ** 2).sum(1))

    for q in range(len(queries)):
        table, inner = codec.tables(moved[q : q + 1])[0], np.zeros(len(ids))
        for p in range(len(packed)):
            inner += table[p].take(packed[p])
        other = ids != query_ids[q]
        score = inner - length / 2
        score[~other] = -np.inf
        at = best_rows(score, ids, candidates, distinct)
        at = at[other[at]]
        d = distances(q, at)
        best = nearest_ids(np.full(len(at), q), ids[at], d, k)
        bound = d[best[-1]] if len(best) == k else np.inf
        if within is not None:
            bound = min(bound, within[q])
        slack = ROUNDING * (own[q] + length + size)
        # Not farther than the bound by what the codes tell, then by the vectors' inner products; comparisons with what isn't a number keep a row.
        open_ = other & ~(np.sqrt(np.maximum(own[q] + length - 2 * inner - slack, 0)) - residual > bound * (1 + ROUNDING))
        open_[at] = False
        more = np.flatnonzero(open_)
        if len(more):
            products = centred @ moved[q] if 4 * len(more) > len(ids) else centred[more] @ moved[q]
            products = products[more] if len(products) != len(more) else products
            more = more[~(own[q] + size[more] - 2 * products - slack[more] > bound**2 * (1 + ROUNDING))]
            at, d = np.concatenate([at, more]), np.concatenate([d, distances(q, more)])
            best = nearest_ids(np.full(len(at), q), ids[at], d, k)
        out_q.append(np.full(len(best), q))
        out_i.append(ids[at][best])
        out_d.append(d[best])
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_d)


def usable(vec: Column) -> Column:
    """Neither null nor zero nor with components that are null or not finite."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def anisotropic_search(df: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, candidates: int = 96) -> DataFrame:
    """(query_id, rank, id, score): for each row that ``queries`` holds for, its k nearest other ids by Euclidean distance, ties to the lesser id.

    Vectors that aren't usable, have a null id or another length than most (the shorter of two as frequent) take no part. Rows with the query's own id
    aren't its neighbours; a repeated row counts once as a query and once as a neighbour. With fewer than k others, all are returned. Empty input: no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(queries, F.lit(False)).alias("is_query")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    result = "query_id long, rank int, id long, score double"
    if lengths is None:
        return spark.createDataFrame([], result).withColumnRenamed("id", id_col)
    dim = lengths["n"]
    rows = rows.where(F.size("vec") == dim)
    most = max(1, min(SAMPLE, SAMPLE_VALUES // dim))
    luck = F.abs(F.xxhash64("id", "vec", F.lit("ann"))) / F.lit(float(1 << 63))
    # By a threshold first, so that tasks send no more than the sample among them.
    sample = rows.where(luck < min(1.0, 1.1 * most / lengths["count"] + 100 / lengths["count"])).orderBy(luck, "id").limit(most).select("vec").toPandas()["vec"]
    sample = np.stack(sample.to_numpy())
    codec = AnisotropicCodec(dim)
    codec.mean = sample.mean(axis=0)
    codec.fit(sample - codec.mean)

    def values(column) -> np.ndarray:
        return column.flatten().to_numpy().reshape(len(column), dim)

    def code(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                codes = [c.tobytes() for c in codec.encode(codec.split(values(batch.column(1)) - codec.mean))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], ["id", "vec", "is_query", "code"])

    rows = stage_table(rows.mapInArrow(code, "id long, vec array<double>, is_query boolean, code binary"), "vectors")
    asked = rows.where("is_query").dropDuplicates(["id"])
    asked = stage_table(asked.select("id", "vec"), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def block(b: int) -> DataFrame:
        got = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toPandas()
        query_ids = got["id"].to_numpy(dtype=np.int64)
        vectors = np.stack(got["vec"].to_numpy()) if len(got) else np.zeros((0, dim))

        def scan(batches: Iterator) -> Iterator:
            import pyarrow as pa

            best, within = None, np.full(len(query_ids), np.inf)
            for batch in batches:
                if not len(batch) or not len(query_ids):
                    continue
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(batch), codec.parts)
                found = search_batch(codec, query_ids, vectors, batch.column(0).to_numpy(), values(batch.column(1)), codes, k, candidates, within)
                if best is not None:
                    found = tuple(np.concatenate(x) for x in zip(best, found, strict=True))
                at = nearest_ids(*found, k)
                best = tuple(x[at] for x in found)
                full = np.bincount(best[0], minlength=len(query_ids)) == k
                within = np.where(full, np.maximum.reduceat(np.append(best[2], 0.0), np.searchsorted(best[0], np.arange(len(query_ids)))), np.inf)
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "id", "score"])

        return rows.select("id", "vec", "code").mapInArrow(scan, "query_id long, id long, score double")

    # A block's queries leave the driver before the next one's come.
    parts = [block(0)] if blocks == 1 else [stage_table(block(b), f"found{b}") for b in range(blocks)]
    near = reduce(DataFrame.unionByName, parts).groupBy("query_id", "id").agg(F.min("score").alias("score"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def op8_anisotropic_search(spark, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector of ``embeddings``."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return anisotropic_search(rows, F.col("vec_id") % 100 == 0)
