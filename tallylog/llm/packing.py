"""Best-fit packing into sequences of fixed length, in bulk-synchronous supersteps.

Only the last piece of a document can be shorter than a sequence, and a length is one of at most ``capacity`` integers. So documents of one length, and gaps of one size, are
interchangeable: documents and gaps are tables of runs, (length, how many) and (gap, first sequence, how many), in order of size. A superstep takes the documents of one octave of lengths,
the longest first, and the gaps that can hold them. A sweep over both finds each run's successor among the gaps, matches documents to gaps by their rank in the two runs (the
ranks beyond the shorter run are the conflicts, and go to the next successor), and updates the gaps; what finds no gap opens sequences. The gaps are written, and
the next octave follows: this is best fit in decreasing order, exactly. The driver sees how many documents there are, and nothing else.

Where documents are more than ``STRIPE``, they are dealt by rank into stripes of so many, whose sweeps run side by side with gaps of their own: a task's table has a few
rows a length, whatever the corpus, and packing costs at most one sequence a stripe more.

Rows never take part in the supersteps. They are ranked within their length by a distributed prefix sum (lengths dealt into salted
cells, as one length may hold a third of all rows), and meet their run's places in one last join.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cell_offsets, give_back, md5_long, salts_for, stage_table

CAPACITY = 4096
END_ID = 1
#: Documents whose runs are swept together.
STRIPE = 4_000_000
#: Words whose ids a worker keeps at a time.
CACHED_WORDS = 200_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words in which lower case, composition and white space hold no surprises; any other goes to the tokenizer itself.
PLAIN = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u024f]+")
#: Upper case is gone after normalisation, so that these can mark the end of a piece and of a word.
END, NEXT = "A", "B"


class WordEncoder:
    """A text's ids, word by word.

    No token of this kind of vocabulary (BPE with word ends, white space dropped) reaches over white space, and neither does
    its normaliser, so a text's ids are those of its words in a row, each found once while it stays among the words known.
    New plain words are merged in one call by a second library that is given the same merges: there a word's end is a
    byte of its own, whose merge with the letter before it comes first of all.
    """

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        spec = json.loads(open(path, encoding="utf-8").read())
        suffix, vocab = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        splits = [x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        self.cut = regex.compile(f"(?:{splits[0]})")
        # Byte-level vocabularies show bytes that aren't printable as the characters from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        plain = lambda token: bytes(byte[c] for c in token.removesuffix(suffix)) + END.encode() * token.endswith(suffix)
        ranks: dict[bytes, int] = {}
        ids: list[int] = []

        def put(token: bytes, number: int) -> None:
            if token not in ranks:
                ranks[token] = len(ids)
                ids.append(number)

        for b in range(256):
            put(bytes([b]), -1)
        for c, b in byte.items():
            put(bytes([b]) + END.encode(), vocab[c + suffix])
        for c, b in byte.items():
            ids[ranks[bytes([b])]] = vocab[c]
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            put(plain(left + right), vocab[left + right])
        self.ids = np.array(ids, dtype="<u4")
        self.next = ranks[NEXT.encode()]
        self.fast = tiktoken.Encoding("words", pat_str=rf"[^{END}{NEXT}\s]+{END}|{NEXT}", mergeable_ranks=ranks, special_tokens={})

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > CACHED_WORDS:
            self.known = {"": b""}
        plain = [w for w in words if PLAIN.fullmatch(w) and "<|" not in w]
        if plain:
            marked = self.cut.sub(rf"\g<0>{END}", "\n".join(plain).lower()).replace("\n", NEXT)
            got = np.array(self.fast.encode_ordinary(marked), dtype=np.int64)
            ends = np.flatnonzero(got == self.next) * 4
            data = self.ids[got].tobytes()
            start = 0
            for word, end in zip(plain, [*ends.tolist(), len(data)], strict=True):
                self.known[word] = data[start:end]
                start = end + 4
        if odd := [w for w in words if w not in self.known]:
            for word, found in zip(odd, self.tokenizer.encode_batch(odd, add_special_tokens=False), strict=True):
                self.known[word] = np.array(found.ids, dtype="<u4").tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self.known)
        if new:
            self._learn(list(new))
        known, out = self.known, []
        for words in split:
            try:
                out.append(b"".join([known[w] for w in words]))
            except KeyError:  # words known before were dropped to make room
                self._learn([w for w in dict.fromkeys(words) if w not in known])
                known = self.known
                if any(w not in known for w in words):
                    self._learn([w for w in dict.fromkeys(words) if w not in known])
                out.append(b"".join([known[w] for w in words]))
        return out


def pieces(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids with the end id; only documents longer than ``capacity`` are cut."""
    ids += END_ID.to_bytes(4, "little")
    width = 4 * capacity
    return [(k, k * capacity, len(part := ids[k * width : (k + 1) * width]) // 4, zlib.crc32(part)) for k in range(-(-len(ids) // width))]


def sweep(counts: dict[int, int], gaps: list[tuple[int, int, int]], opened: int, capacity: int = CAPACITY) -> tuple[list, list, int]:
    """One superstep over runs of documents (length: how many) and of gaps (gap, first sequence, how many).

    Returns (rows (length, first rank, first sequence, offset): documents of a length from that rank on, up to the next row's, go to sequences from that number on;
    the gaps left; the number of sequences opened so far).
    """
    by_size: dict[int, list[tuple[int, int]]] = {}
    for gap, first, n in gaps:
        by_size.setdefault(gap, []).append((first, n))
    sizes, plan = sorted(by_size), []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)  # the successor
            if at < len(sizes):
                gap = sizes[at]
                first, n = by_size[gap].pop()
                took = min(n, left)
                if took < n:
                    by_size[gap].append((first + took, n - took))
                elif not by_size[gap]:
                    del by_size[gap], sizes[at]
            else:
                gap, first = capacity, opened
                took = -(-left // (capacity // length))  # each new one takes as many of this run as fit
                opened += took
            plan.append((length, rank, first, capacity - gap))
            rank, left = rank + took, left - took
            if gap > length:
                if gap - length not in by_size:
                    by_size[gap - length] = []
                    bisect.insort(sizes, gap - length)
                by_size[gap - length].append((first, took))
    return plan, [(gap, first, n) for gap in sizes for first, n in by_size[gap]], opened


def octaves(capacity: int) -> list[tuple[int, int]]:
    """(greatest length, least length) of each superstep."""
    out, top = [], capacity
    while top:
        out.append((top, top // 2 + 1))
        top //= 2
    return out


_STATE = "stripe long, kind int, size int, first long, n long, rank long"
_GAP, _OPENED, _PLACE, _RUN = range(4)


def best_fit_runs(runs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(stripe, length, places) from (stripe, length, n): where the documents of each run go, as an array of (rank, first, offset) by rank."""

    def superstep(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        of = {k: pdf[pdf["kind"] == k] for k in (_GAP, _OPENED, _RUN)}
        gaps = list(of[_GAP][["size", "first", "n"]].itertuples(index=False, name=None))
        plan, gaps, opened = sweep(dict(zip(of[_RUN]["size"].tolist(), of[_RUN]["n"].tolist(), strict=True)), gaps, int(of[_OPENED]["n"].sum()), capacity)
        rows = [(key[0], _OPENED, 0, 0, opened, 0)] + [(key[0], _GAP, g, f, n, 0) for g, f, n in gaps] + [(key[0], _PLACE, length, first, offset, rank) for length, rank, first, offset in plan]
        return pd.DataFrame(rows, columns=["stripe", "kind", "size", "first", "n", "rank"])

    spark, zero = runs.sparkSession, F.lit(0).cast("long")
    state = spark.createDataFrame([], _STATE)
    placed = []
    for top, low in octaves(capacity):
        docs = runs.where(F.col("length").between(low, top)).select("stripe", F.lit(_RUN).alias("kind"), F.col("length").cast("int").alias("size"), zero.alias("first"), "n", zero.alias("rank"))
        # Gaps too small for this octave wait; they need no sweep.
        active = state.where((F.col("kind") == _OPENED) | (F.col("size") >= low)).unionByName(docs)
        done = stage_table(active.groupBy("stripe").applyInPandas(superstep, _STATE).unionByName(state.where((F.col("kind") == _GAP) & (F.col("size") < low))).coalesce(8), "superstep")
        placed.append(done.where(F.col("kind") == _PLACE))
        state = done.where(F.col("kind") != _PLACE)
    places = placed[0]
    for p in placed[1:]:
        places = places.unionByName(p)
    return places.groupBy("stripe", F.col("size").cast("long").alias("length")).agg(F.array_sort(F.collect_list(F.struct("rank", "first", F.col("n").alias("offset")))).alias("places"))


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of all documents; the text stays behind. A null text is an empty one, of length 1."""
    path = path or tokenizer_path()
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = WordEncoder(path)
        for batch in batches:
            ids, rows, owner, texts = batch.column(0), [], [], batch.column(1)
            for low in range(0, len(texts), 200):
                for i, found in enumerate(encoder.encode_batch(texts.slice(low, 200).to_pylist()), low):
                    for row in pieces(found, capacity):
                        owner.append(i)
                        rows.append(row)
            made = np.array(rows, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner, pa.int64())), pa.array(made[:, 0].astype(np.int32)), pa.array(made[:, 1]), pa.array(made[:, 2]), pa.array(made[:, 3])], ["id", "piece", "start", "length", "ids_crc32"])
            del batch, ids, texts, rows, owner, made
            give_back()

    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, stripe: int = STRIPE) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``.

    Repeated rows are packed each for itself; equal ones may swap places, which leaves the result as it is. An empty input gives no rows.
    Other columns of ``df`` are not carried, so their names can't clash.
    """
    made = stage_table(token_pieces(df, id_col, text_col, path, capacity), "pieces")
    keys, total = ["length", "_part"], made.count()
    stripes = max(1, total // stripe)
    made = made.withColumn("_part", (md5_long(F.col("id"), F.col("piece"), salt="pack") % salts_for(total)).cast("int"))
    cells = stage_table(made.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "lengths")
    runs = cells.groupBy("length").agg(F.sum("_n").alias("_n")).withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))))
    runs = runs.select("stripe", "length", (F.floor(F.col("_n") / stripes) + (F.col("stripe") < F.col("_n") % stripes).cast("int")).cast("long").alias("n")).where("n > 0")
    places = stage_table(best_fit_runs(stage_table(runs, "runs"), capacity), "places")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("id", "piece", "ids_crc32")) - 1
    ranked = made.withColumn("_rank", rank).join(cell_offsets(cells, ["length"], ["_part"]).drop("_n"), keys).withColumn("_rank", F.col("_rank") + F.col("_offset"))
    ranked = ranked.withColumns({"stripe": F.col("_rank") % stripes, "_rank": F.floor(F.col("_rank") / stripes)})
    at = F.element_at(F.filter("places", lambda p: p["rank"] <= F.col("_rank")), -1)
    placed = ranked.join(places, ["stripe", "length"]).withColumn("_at", at)
    sequence = (F.col("_at.first") + F.col("_rank") - F.col("_at.rank")) * stripes + F.col("stripe")
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", sequence.cast("long").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def op6_best_fit(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, packed into sequences of 4096 tokens."""
    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
