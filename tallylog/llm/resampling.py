"""Importance resampling towards a target's distribution of hashed word runs, with word tries that are local to a task.

1. *Counting.* A task walks the words of its texts down a trie: a path from the root is a run of words, its node holds how often the run occurred and the CRC-32 state
   of its bytes, from which a child's state is continued (a blank, then the next word) without hashing the run anew. What leaves a task is its counts by bucket (state modulo ``buckets``), never its words.
2. *Gains.* The totals of both sides, ``buckets`` rows, give each bucket's gain: 1000 times the logarithm of how much more frequent it is in the target.
3. *Scoring.* Tasks walk the texts again, down tries whose nodes have their bucket's gain attached. A document's weight is the floored mean of gains, its score adds Gumbel noise from a digest
   of its id, so that the highest scores are a draw without replacement whose chances are in proportion to exp(weight / 1000).
4. *Drawing.* Scores are whole numbers within about 2**17 of each other (gains and noise are logarithms), so a count by score is a small table whatever the input. It gives
   the last score drawn and each score's first rank; within a score, ranks are prefix sums over cells of (id, a salt).

A trie of more than ``NODES`` nodes is folded into the totals and begun anew, so that memory doesn't grow with the vocabulary; texts are cut at blanks into slices of ``SLICE`` bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, positional, restored, stage_table
from .shingles import byte_slices

NODES, SLICE = 1 << 20, 1 << 20
#: Cells that rows of one score and id are dealt into.
SALTS = 256
#: A-Z to a-z; other ASCII bytes than digits and letters to blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def word_slices(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text in order, those of about ``size`` bytes at a time."""
    folded, low = text.translate(_FOLD), 0
    while low < len(folded):
        high = folded.find(b" ", low + size) if low + size < len(folded) else -1
        high = len(folded) if high < 0 else high
        yield folded[low:high].split()
        low = high


class WordTrie(dict):
    """Runs of 1 to ``longest`` words. Nodes are numbers in order of their making; the dictionary itself holds the root's children by word, ``deeper`` those of other nodes."""

    def __init__(self, longest: int, gains: np.ndarray | None = None, buckets: int = 0) -> None:
        self.longest, self.table, self.buckets = longest, gains, buckets
        self.states: list[int] = []
        self.gains: list[int] = []
        self.words: list[bytes] = []  # the last word of each node
        self.deeper: dict[tuple[int, int], int] = {}
        self.counts = np.zeros(0, np.int64)
        self.last: list[int] = []

    def grow(self, word: bytes, state: int) -> int:
        self.states.append(state)
        self.words.append(word)
        if self.table is not None:
            self.gains.append(int(self.table[state % self.buckets]))
        return len(self.states) - 1

    def __missing__(self, word: bytes) -> int:
        node = self[word] = self.grow(word, crc32(word))
        return node

    def walk(self, words: list[bytes], before: list[bytes] = ()) -> Iterator[list[int]]:
        """For each length the nodes of all runs that end in ``words``; ``before`` are the words just before them."""
        firsts = list(map(self.__getitem__, [*before, *words]))
        nodes = firsts
        for depth in range(1, self.longest + 1):
            if depth > 1:
                nodes = [self.step(p, c) for p, c in zip(nodes[: len(nodes) - 1], firsts[depth - 1 :], strict=True)]
            yield nodes[max(0, len(before) - depth + 1) :]

    def step(self, parent: int, word: int) -> int:
        node = self.deeper.get((parent, word))
        if node is None:
            node = self.deeper[parent, word] = self.grow(self.words[word], crc32(self.words[word], crc32(b" ", self.states[parent])))
        return node

    def count(self, nodes: list[int]) -> None:
        found = np.bincount(np.array(nodes, np.int64), minlength=len(self.counts))
        found[: len(self.counts)] += self.counts
        self.counts = found

    def totals(self, buckets: int) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        np.add.at(out, np.array(self.states[: len(self.counts)], np.int64) % buckets, self.counts)
        return out


def _walked(texts: list[bytes], longest: int) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """(number of the text, some words of it, the ``longest`` - 1 words just before these)."""
    for i, text in enumerate(texts):
        before: list[bytes] = []
        for words in word_slices(text):
            yield i, words, before
            before = (before + words)[-(longest - 1) :] if longest > 1 else []


def bucket_totals(df: DataFrame, text_col: str, longest: int, buckets: int, nodes: int = NODES) -> DataFrame:
    """(bucket, n): how many runs of 1 to ``longest`` words of all texts fall into each bucket."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        trie, totals, held = WordTrie(longest), np.zeros(buckets, np.int64), []
        for batch in batches:
            for _, _, texts in byte_slices(batch.column(0)):
                for _, words, before in _walked(texts, longest):
                    for found in trie.walk(words, before):
                        held += found
                    if len(held) > 1 << 17 or len(trie.states) > nodes:
                        trie.count(held)
                        held = []
                    if len(trie.states) > nodes:
                        totals += trie.totals(buckets)
                        trie = WordTrie(longest)
        trie.count(held)
        totals += trie.totals(buckets)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(totals[at])], ["bucket", "n"])

    return df.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln of the target's smoothed frequency over the raw one's) for each bucket."""
    s, t = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s / ((raw.get(b, 0) + 1.0) * t))) for b in range(buckets)], np.int64)


def _scored(df: DataFrame, text_col: str, gains: np.ndarray, longest: int, buckets: int, nodes: int) -> DataFrame:
    """``df`` with _features, _words and _weight."""
    at = df.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        trie = WordTrie(longest, gains, buckets)
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for low, high, texts in byte_slices(batch.column(at)):
                features, n_words, total = ([0] * (high - low) for _ in range(3))
                for i, words, before in _walked(texts, longest):
                    n_words[i] += len(words)
                    for found in trie.walk(words, before):
                        features[i] += len(found)
                        total[i] += sum(map(trie.gains.__getitem__, found))
                    if len(trie.states) > nodes:
                        trie = WordTrie(longest, gains, buckets)
                rows += [(f, w, t // f if f else 0) for f, w, t in zip(features, n_words, total, strict=True)]
            added = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3
            keep = [c for k, c in enumerate(batch.columns) if k != at]
            names = [c for k, c in enumerate(batch.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays([*keep, *added], [*names, "_features", "_words", "_weight"])

    schema = df.drop(text_col).schema
    for name in ("_features", "_words", "_weight"):
        schema = schema.add(name, "long")
    return df.mapInArrow(run, schema)


def importance_resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024", carry: list[str] | None = None, nodes: int = NODES) -> DataFrame:
    """Every row of ``df`` with its columns ``carry`` (all but the text unless given; give the text a second name to carry it) and ``n_features``, ``weight``, ``score`` and ``rank``: 1, 2 ... by
    falling score, then rising id, for the ``percent`` % (rounded down) of the documents with ``least_words`` words or more that are drawn; null for others.

    A null or empty text has no features and weight 0. A null id is hashed as an empty one and comes last among ties; rows that share an id are documents of their own, those with the same
    score go by ``n_features``, and may else swap ranks. Very long texts are walked in slices. An empty target gives smoothed gains as any other; an empty input gives no rows.
    Names of ``df`` that clash with the new ones stay, and the new ones get leading underscores.
    """
    carry = [c for c in df.columns if c != text_col] if carry is None else carry
    out = fresh(df.select(*[F.col(f"`{c}`") for c in carry]), "n_features", "weight", "score", "rank")
    sides = [bucket_totals(d, c, longest, buckets, nodes).collect() for d, c in ((df, text_col), (target, target_text))]  # ``buckets`` rows at most
    gains = bucket_gains(*[{r["bucket"]: r["n"] for r in side} for side in sides], buckets)
    narrow = df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    narrow, ident, text = narrow.toDF(*[f"c{i}" for i in range(len(carry) + 2)]), f"c{len(carry)}", f"c{len(carry) + 1}"
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(ident).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    scored = _scored(narrow, text, gains, longest, buckets, nodes).withColumns({"_score": F.col("_weight") + noise, "_salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")})
    scored = stage_table(scored, "scored")
    eligible = F.col("_words") >= least_words
    counts = sorted(((r["_score"], r["n"]) for r in scored.where(eligible).groupBy("_score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    quota = percent * sum(n for _, n in counts) // 100
    cells, taken = [], 0
    for score, n in counts:
        if taken >= quota:
            break
        cells.append((score, taken))
        taken += n
    if not cells:
        ranked = scored.withColumn("_rank", F.lit(None).cast("long"))
    else:
        high = eligible & (F.col("_score") >= cells[-1][0])
        cell = ["_score", ident, "_features", "_salt"]
        some = scored.where(high)
        firsts = df.sparkSession.createDataFrame(cells, "_score long, _first long")
        before = Window.partitionBy("_score").orderBy(F.col(ident).asc_nulls_last(), "_features", "_salt").rowsBetween(Window.unboundedPreceding, -1)
        offsets = some.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        offsets = offsets.join(F.broadcast(firsts), "_score").select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cell)], (F.col("_first") + F.col("_offset")).alias("_offset"))
        same = [F.col(c).eqNullSafe(F.col(f"k{i}")) for i, c in enumerate(cell)]
        place = F.col("_offset") + F.row_number().over(Window.partitionBy(*cell).orderBy(F.lit(1)))
        placed = some.join(offsets, on=same[0] & same[1] & same[2] & same[3]).withColumn("_rank", place)
        placed = placed.withColumn("_rank", F.when(F.col("_rank") <= quota, F.col("_rank")).cast("long")).select(*scored.columns, "_rank")
        ranked = placed.unionByName(scored.where(~high).withColumn("_rank", F.lit(None).cast("long")))
    return ranked.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *[F.col(c).alias(n) for c, n in zip(("_features", "_weight", "_score", "_rank"), out, strict=True)])


def op13_word_trie_resampling(spark, sf_dir: str) -> DataFrame:
    """A tenth of ``documents`` of 20 words and more, drawn towards the words of ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return importance_resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
wanted AS (SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
raw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM docs) GROUP BY ALL),
aim AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM wanted) GROUP BY word),
vocabulary AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM raw UNION SELECT word FROM aim)),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket FROM vocabulary, crc),
s AS (SELECT bucket, sum(n) AS s FROM raw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM aim JOIN hashed USING (word) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
sums AS (SELECT doc_id, sum(n * gain) AS total, sum(n) AS features FROM raw JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
weighed AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / features), 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM docs LEFT JOIN sums USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
