"""Substring deduplication by prefix-partitioned suffix trees over words.

Every run of ``length`` words (a window) that also starts in a document with a smaller id is removed.

1. *Which places can repeat.* In each window the least hash among its eight-word runs is its core; equal windows have equal cores at the same place. A core that
   only one document has has no repeat around it and is dropped: exact in one direction (a chance agreement of hashes keeps a core too many, and never loses one).
   Cores are exchanged by ranges of their hash; a range that holds more than ``LOT_BYTES``, as that of a passage everyone has, is dealt into lots, each of which
   reports its cores' least and greatest documents only.
2. *Suffixes.* A suffix begins at each core left, and carries its next ``PATH`` words and the five before it, the words themselves. Within a part of the corpus
   equal ones go as one, from the least id; the others are settled on the spot. A suffix is six times as large as the text from its core to the next, so a part's are cut
   into pieces of ``PIECE``: what a task holds at a time doesn't depend on how much of the corpus repeats.
3. *Groups by prefixes of variable length.* Suffixes are counted by their first word; where more than ``GROUP`` share it, by the first two, then four, then eight. Each group thus
   fits a task's memory. Where even eight words are shared by more, the prefix is a whole window: its least id is aggregated and met again in salted lots, never gathered.
4. *Trees.* A task sorts its groups' suffixes by their paths; the depths that neighbours share, in words, make the tree. A node of d words, with those to the left that its suffixes
   share, is a repeat where left and right make ``length`` or more and its suffixes are of several documents. Every suffix of a node but those of the least id returns the stretch of its
   deepest such node. Words are compared as words here, not by hashes.
5. *Removal.* The stretches return to their documents, whose covered words go.

Parts, hash ranges and groups grow in number with the bytes of the corpus, and so stay of one size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, stage_table
from .shingles import byte_slices, mix, new_key, run_hashes, sub_batches, word_hashes

LENGTH, CORE, PATH = 13, 8, 16
#: Bytes of text for each part of the documents and for each range of cores; bytes of cores in a lot.
PART_BYTES, RANGE_BYTES, LOT_BYTES = 2 << 20, 20 << 20, 8 << 20
#: Suffixes in a row of the table of suffixes (about 110 bytes each), rows in a file of it, suffixes that a task holds while it deals them to groups, and bytes it returns at a time.
PIECE, PIECES, DEAL, SENT_BYTES = 1 << 14, 10, 1 << 18, 4 << 20
#: Suffixes in a group of one prefix, and of several prefixes in one task.
GROUP = 1 << 15
#: Lengths of prefixes that are tried in turn. None is longer than a core, as windows reach over less than that to its right.
LADDER = (1, 2, 4, 8)
#: Prefixes of one length that may be too frequent: groups grow where there would be more, so that what the driver holds is bounded.
MOST_PREFIXES = 1 << 20
#: Lots that a window's suffixes are dealt into where its group is never gathered.
SALTS = 32
_NULL_ID = np.iinfo(np.int64).max


def _pack(a: np.ndarray) -> bytes:
    """Sorted or small integers, compressed by planes of bytes."""
    a = np.ascontiguousarray(a, dtype="<u4" if a.dtype.itemsize == 4 else "<i8")
    return zlib.compress(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def cores(words: np.ndarray, first: np.ndarray, length: int = LENGTH, core: int = CORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all runs of ``core`` words, places of the cores, the document of each) for the words of several documents, which begin at ``first``."""
    runs = run_hashes(words, core, 2)
    n = len(words) - length + 1
    if n <= 0:
        return runs, np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(owner[:n] == owner[length - 1 :])
    best, at = runs[starts].copy(), starts.copy()
    for o in range(1, length - core + 1):
        other = runs[starts + o]
        less = other < best
        best[less], at[less] = other[less], starts[less] + o
    places = np.unique(at)
    return runs, places, owner[places]


def _groups(a: np.ndarray):
    """(value, start, end) of each run of equal values."""
    cut = np.flatnonzero(np.diff(a)) + 1 if len(a) else np.zeros(0, np.int64)
    edges = [0, *cut.tolist(), len(a)]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        if high > low:
            yield a[low], low, high


def _by_doc(doc: np.ndarray) -> tuple[bytes, bytes]:
    own, counts = np.unique(doc, return_counts=True)
    return _pack(own), _pack(counts.astype(np.uint32))


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64), 9) % np.uint64(parts)).astype(np.int64)


# 1. Cores that several documents have.


def _core_lists(df: DataFrame, bits: int, length: int, key: int) -> DataFrame:
    """(range, docs, counts, keys) rows: for each hash range, the cores that a batch has there, four bytes each."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
            made = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for low, high, texts in byte_slices(batch.column(1)):
                words, first, *_ = word_hashes(texts, key)
                runs, places, owner = cores(words, first, length)
                made.append((runs[places] >> np.uint64(32 - bits), ids[low:high][owner]))
            found, doc = (np.concatenate(x) for x in zip(*made, strict=True))
            order = np.lexsort((found, doc, found >> np.uint64(32)))
            found, doc = found[order], doc[order]
            new = np.ones(len(found), dtype=bool)
            new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
            found, doc = found[new], doc[new]
            out = []
            for r, a, b in _groups((found >> np.uint64(32)).astype(np.int64)):
                out.append((int(r), *_by_doc(doc[a:b]), (found[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *[pa.array([o[k] for o in out], pa.binary()) for k in (1, 2, 3)]], ["range", "docs", "counts", "keys"])
            give_back()

    return df.mapInArrow(run, "range int, docs binary, counts binary, keys binary")


def _listed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(documents, cores' four bytes) of some rows of one range."""
    doc = np.concatenate([np.repeat(_unpack(d, "<i8"), _unpack(c, "<u4")) for d, c in zip(pdf["docs"], pdf["counts"], strict=True)])
    return doc, np.concatenate([np.frombuffer(k, "<u4") for k in pdf["keys"]])


def _ends_of(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, with the least and the greatest document."""
    order = np.argsort(keys, kind="stable")
    keys, low, high = keys[order], low[order], high[order]
    at = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[at], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)


def _lot_ends(pdf: pd.DataFrame) -> pd.DataFrame:
    doc, keys = _listed(pdf)
    keys, low, high = _ends_of(keys, doc, doc)
    return pd.DataFrame({"range": [pdf["range"].iloc[0]], "keys": [_pack(keys)], "low": [_pack(low)], "high": [_pack(high)]})


def _two_docs(pdf: pd.DataFrame) -> pd.DataFrame:
    """The cores of a range whose least and greatest documents differ."""
    keys, low, high = _ends_of(*[np.concatenate([_unpack(b, kind) for b in pdf[c]]) for c, kind in (("keys", "<u4"), ("low", "<i8"), ("high", "<i8"))])
    return pd.DataFrame({"range": [pdf["range"].iloc[0]], "shared": [_pack(keys[low < high])]})


def _return_cores(parts: int, bits: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"part": [], "docs": [], "counts": [], "keys": []})
        doc, keys = _listed(left)
        keep = np.isin(keys, _unpack(right["shared"].iloc[0], "<u4"))
        doc, keys = doc[keep], keys[keep].astype(np.uint64) | (np.uint64(int(left["range"].iloc[0])) << np.uint64(32))
        part = part_of(doc, parts)
        order = np.lexsort((keys, doc, part))
        doc, keys, part = doc[order], keys[order], part[order]
        rows = [(int(p), *_by_doc(doc[a:b]), keys[a:b].astype("<u8").tobytes()) for p, a, b in _groups(part)]
        return pd.DataFrame(rows, columns=["part", "docs", "counts", "keys"])

    return run


def shared_cores(docs: DataFrame, parts: int, bits: int, length: int, key: int, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """(part, docs, counts, keys): the documents of each part and their cores that another document has, too."""
    held = stage_table(_core_lists(docs, bits, length, key), "cores")
    lots = held.groupBy("range").agg(F.ceil(F.sum(F.octet_length("keys")) / lot_bytes).cast("int").alias("lots"))
    dealt = held.join(lots, "range").withColumn("lot", F.pmod(F.xxhash64("docs", "keys"), F.col("lots")).cast("int")).drop("lots")
    ends = dealt.groupBy("range", "lot").applyInPandas(_lot_ends, "range int, keys binary, low binary, high binary")
    shared = ends.groupBy("range").applyInPandas(_two_docs, "range int, shared binary")
    each = shared.join(lots, "range").select("range", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "shared")
    return dealt.groupBy("range", "lot").cogroup(each.groupBy("range", "lot")).applyInPandas(_return_cores(parts, bits), "part int, docs binary, counts binary, keys binary")


# 2. Suffixes.


def _parted(df: DataFrame, parts: int) -> DataFrame:
    """(part, id, z): the documents, compressed, each with its part."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch.column(0).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
            z = [pack.compress(t) for _, _, texts in byte_slices(batch.column(1)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(part_of(ids, parts).astype(np.int32)), pa.array(ids), pa.array(z, pa.binary())], ["part", "id", "z"])
            give_back()

    return df.mapInArrow(run, "part int, id long, z binary")


def _open(left: pd.DataFrame) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a part in a fixed order, each different row once."""
    unpack = zstandard.ZstdDecompressor()
    rows = sorted({(int(i), unpack.decompress(z)) for i, z in zip(left["id"], left["z"], strict=True)})
    return np.array([i for i, _ in rows], dtype=np.int64), [t for _, t in rows]


class Suffixes:
    """Suffixes of some documents: a row of word numbers each (``LEFT`` before the core, then the path; 0 where the document has none), the words by number, and where each is from."""

    LEFT = LENGTH - CORE
    KINDS = {"id": "<i8", "row": "<i4", "start": "<i4", "part": "<i4"}

    def __init__(self, codes: np.ndarray, vocabulary: list[bytes], **columns: np.ndarray) -> None:
        self.codes, self.vocabulary, self.columns = codes, vocabulary, columns

    def __len__(self) -> int:
        return len(self.codes)

    def take(self, at: np.ndarray) -> Suffixes:
        return Suffixes(self.codes[at], self.vocabulary, **{k: v[at] for k, v in self.columns.items()})

    def left(self) -> np.ndarray:
        """How many words there are before each core, of those carried."""
        return (self.codes[:, : self.LEFT] > 0).sum(axis=1)

    def right(self) -> np.ndarray:
        return (self.codes[:, self.LEFT :] > 0).sum(axis=1)

    def close(self) -> bytes:
        """Columns of byte planes in the order of paths. Words are numbered as they come, so that a new one, as most are, is 1; others are their number and 2, none is 0."""
        order = np.lexsort(self.codes[:, self.LEFT : self.LEFT + 4].T[::-1])
        flat = self.codes[order].ravel()
        if len(flat) < len(self.vocabulary):  # a few of many: their own words only
            known, flat = np.unique(np.append(0, flat), return_inverse=True)
            flat = flat[1:]
        else:
            known = np.arange(len(self.vocabulary))
        first = np.full(len(known), -1)
        first[flat[::-1]] = np.arange(len(flat))[::-1]
        first[0] = -1
        new = (first[flat] == np.arange(len(flat))) & (flat > 0)
        used = flat[new]
        number = np.zeros(len(known), np.int64)
        number[used] = np.arange(len(used)) + 2
        codes = np.where(new, 1, number[flat]).astype("<u4").reshape(len(order), -1)
        columns = [self.columns[k][order].astype(kind)[:, None] for k, kind in self.KINDS.items()]
        planes = [c.view(np.uint8).reshape(*c.shape, -1).transpose(1, 2, 0).tobytes() for c in (codes, *columns)]
        words = b"\n".join([self.vocabulary[i] for i in known[used].tolist()])
        head = np.array([len(codes), codes.shape[1], len(words)], "<i8").tobytes()
        return head + zstandard.ZstdCompressor(level=3).compress(b"".join([words, *planes]))

    @classmethod
    def unclose(cls, data: bytes) -> Suffixes:
        n, width, size = np.frombuffer(data[:24], "<i8").tolist()
        raw = zstandard.ZstdDecompressor().decompress(data[24:])
        planes, pos, columns = np.frombuffer(raw, np.uint8, offset=size), 0, []
        for kind, m in (("<u4", width), *[(kind, 1) for kind in cls.KINDS.values()]):
            step = n * m * int(kind[2])
            columns.append(np.ascontiguousarray(planes[pos : pos + step].reshape(m, -1, n).transpose(2, 0, 1)).view(kind)[:, :, 0])
            pos += step
        own = {k: c[:, 0] for k, c in zip(cls.KINDS, columns[1:], strict=True)}
        codes = columns[0].astype(np.int32)
        new = (codes == 1).ravel()
        codes = np.where(new, np.cumsum(new), np.maximum(codes.ravel() - 1, 0)).reshape(n, width)
        return cls(codes.astype(np.int32), [b"", *raw[:size].split(b"\n")], **own)

    @classmethod
    def joined(cls, some: Iterable[Suffixes]) -> Suffixes:
        """All together, with one numbering of words; one after the other, so that only numbers are held of each."""
        number: dict[bytes, int] = defaultdict(count().__next__)
        codes, columns = [], []
        for s in some:
            table = np.fromiter(map(number.__getitem__, s.vocabulary), np.int32, len(s.vocabulary))  # the first is b"", and 0
            codes.append(table[s.codes])
            columns.append(s.columns)
        return cls(np.concatenate(codes), list(number), **{k: np.concatenate([c[k] for c in columns]) for k in columns[0]})


def settle(suffixes: Suffixes) -> tuple[Suffixes, Suffixes]:
    """(suffixes of the least id among those that are equal, the others)."""
    mark = np.zeros(len(suffixes), np.uint64)
    for c in suffixes.codes.T:
        mark = mix(mark ^ c.astype(np.uint64))
    order = np.lexsort((suffixes.columns["id"], mark))
    ids, head = suffixes.columns["id"][order], np.zeros(len(order), bool)
    head[:1] = True
    for c in suffixes.codes.T:
        c = c[order]
        head[1:] |= c[1:] != c[:-1]
    least = ids[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    return suffixes.take(order[ids == least]), suffixes.take(order[ids > least])


def _answers(rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> bytes:
    """(row, start, length) of stretches to remove."""
    return np.stack([rows, starts, lengths]).astype("<i4").tobytes()


def _suffixes(length: int, bits: int, key: int):
    """For cogroups of (documents of a part, its cores): rows (kind, part, payload); kind 0: suffixes, ``PIECE`` a row in the order of paths; 2: stretches settled."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"kind": [], "part": [], "payload": []})
        if not len(left) or not len(right):
            return none
        part = int(left["part"].iloc[0])
        ids, texts = _open(left)
        doc = np.concatenate([np.repeat(_unpack(d, "<i8"), _unpack(c, "<u4")) for d, c in zip(right["docs"], right["counts"], strict=True)])
        wanted = np.unique(mix(doc.view(np.uint64), 8) ^ np.concatenate([np.frombuffer(k, "<u8") for k in right["keys"]]))
        number: dict[bytes, int] = {b"": 0}
        span, found = np.arange(-Suffixes.LEFT, PATH), []
        for low, high in sub_batches(texts):
            words, first, begin, end, joined = word_hashes(texts[low:high], key)
            runs, places, owner = cores(words, first, length)
            keep = np.isin(mix(ids[low:high][owner].view(np.uint64), 8) ^ (runs[places] >> np.uint64(32 - bits)), wanted)
            places, owner = places[keep], owner[keep]
            if not len(places):
                continue
            at = places[:, None] + span[None, :]
            inside = (at >= first[owner][:, None]) & (at < first[owner + 1][:, None])
            at = np.where(inside, at, 0)
            data, table = joined.tobytes(), np.zeros(len(words), np.int32)
            table[at[inside]] = 1
            used = np.flatnonzero(table)
            table[used] = [number.setdefault(data[x:y], len(number)) for x, y in zip(begin[used].tolist(), end[used].tolist(), strict=True)]
            found.append((np.where(inside, table[at], 0), ids[low:high][owner], owner + low, places - first[owner]))
        if not found:
            return none
        codes, own, row, start = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        go, others = settle(Suffixes(codes, list(number), id=own, row=row, start=start, part=np.full(len(own), part)))
        before = others.left()
        out = [(2, part, _answers(others.columns["row"], others.columns["start"] - before, before + others.right()))] if len(others) else []
        order = np.lexsort(go.codes[:, Suffixes.LEFT : Suffixes.LEFT + 4].T[::-1])
        out += [(0, part, go.take(order[a : a + PIECE]).close()) for a in range(0, len(order), PIECE)]
        give_back()
        return pd.DataFrame(out, columns=["kind", "part", "payload"])

    return run


def _pieces(found: DataFrame) -> DataFrame:
    """The rows of suffixes; tasks read them as Arrow's, one at a time."""
    return found.where("kind = 0").select("payload")


def _opened(batch) -> Iterator[Suffixes]:
    for p in batch.column(0):
        yield Suffixes.unclose(p.as_buffer())


def _lots(batch, most: int = DEAL) -> Iterator[Suffixes]:
    """The suffixes of a batch, about ``most`` at a time."""
    held: list[Suffixes] = []
    for s in _opened(batch):
        held.append(s)
        if sum(map(len, held)) >= most:
            yield Suffixes.joined(held)
            held = []
    if held:
        yield Suffixes.joined(held)


# 3. Groups by prefixes.


def _assigned(suffixes: Suffixes, key: int, heavy: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, level) of each suffix: the shortest of ``LADDER`` that isn't among the frequent ones; level ``len(heavy)`` where all those known so far are."""
    words = np.zeros(len(suffixes.vocabulary), np.uint64)
    words[1:] = word_hashes([b"\n".join(suffixes.vocabulary[1:])], key)[0]
    path, mark = suffixes.codes[:, Suffixes.LEFT :], np.zeros(len(suffixes), np.uint64)
    prefix, level = mark, np.zeros(len(suffixes), np.int64)
    for k in range(min(len(heavy) + 1, len(LADDER))):
        for j in range(LADDER[k - 1] if k else 0, LADDER[k]):
            mark = mix(mark ^ words[path[:, j]])
        here = level == k
        prefix = np.where(here, mark, prefix)
        if k < len(heavy):
            level = level + (here & np.isin(mark, heavy[k]))
    return prefix, level


def frequent_prefixes(found: DataFrame, key: int, group: int = GROUP) -> tuple[list[np.ndarray], int]:
    """For each length of ``LADDER`` the prefixes that more suffixes share than fit a group, as hashes; and the number of suffixes. At most ``MOST_PREFIXES`` a length get to the driver."""
    heavy: list[np.ndarray] = []
    total = 0
    for k in range(len(LADDER)):

        def counts(batches: Iterator, heavy: list[np.ndarray] = tuple(heavy), k: int = k) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                seen = [np.zeros(0, np.uint64)]
                for s in _opened(batch):
                    prefix, level = _assigned(s, key, list(heavy))
                    seen.append(prefix[level == k])
                own, n = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["prefix", "n"])
                give_back()

        counted = _pieces(found).mapInArrow(counts, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
        if not k:
            counted = stage_table(counted, "prefixes")
            total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            group = max(group, total // MOST_PREFIXES)
        rows = counted.where(F.col("n") > group).select("prefix").collect()
        heavy.append(np.array(sorted(r["prefix"] for r in rows), np.int64).view(np.uint64))
        if not rows:
            break
    return heavy, total


def _dealt(found: DataFrame, key: int, heavy: list[np.ndarray], tasks: int) -> DataFrame:
    """(task, payload): suffixes by group, but for those whose core itself is too frequent."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(made: list[tuple[int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in made], pa.int32()), pa.array([p for _, p in made], pa.binary())], ["task", "payload"])

        for batch in batches:
            for suffixes in _lots(batch):
                prefix, level = _assigned(suffixes, key, heavy)
                task = (mix(prefix, 3) % np.uint64(tasks)).astype(np.int64)
                at = np.flatnonzero(level < len(LADDER))
                order = at[np.argsort(task[at], kind="stable")]
                made, size = [], 0
                for t, a, b in _groups(task[order]):
                    made.append((int(t), suffixes.take(order[a:b]).close()))
                    size += len(made[-1][1])
                    if size >= SENT_BYTES:
                        yield rows(made)
                        made, size = [], 0
                yield rows(made)
            give_back()

    return _pieces(found).mapInArrow(run, "task int, payload binary")


# 4. Trees.


def shared_depths(path: np.ndarray) -> np.ndarray:
    """For sorted paths, how many words each shares with the one before it."""
    n, width = path.shape
    if not n:
        return np.zeros(0, np.int64)
    differ = np.ones((n - 1, width + 1), bool)
    differ[:, :width] = path[1:] != path[:-1]
    depth = np.minimum(differ.argmax(axis=1), np.minimum((path[1:] > 0).sum(axis=1), (path[:-1] > 0).sum(axis=1)))
    return np.concatenate([[0], depth])


def _least(starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id of the run that each row is in; ``starts`` marks where runs begin."""
    at = np.flatnonzero(starts)
    return np.minimum.reduceat(ids, at)[np.cumsum(starts) - 1]


def repeats(suffixes: Suffixes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the repeat of each suffix that is in a document with a smaller id, too; length 0 where there is none.

    Cutting the tree at depth d leaves its nodes of d words as runs of the sorted suffixes. At the core itself nodes of ``length`` words and more count; with o words
    to the left, nodes of ``length`` - o words, each split by these words.
    """
    n = len(suffixes)
    path, before = suffixes.codes[:, Suffixes.LEFT :], suffixes.codes[:, : Suffixes.LEFT][:, ::-1]
    order = np.lexsort(path.T[::-1])
    path, before, ids = path[order], before[order], suffixes.columns["id"][order]
    depth, right, left = shared_depths(path), (path > 0).sum(axis=1), (before > 0).sum(axis=1)
    deepest = np.zeros(n, np.int64)
    for d in range(length, path.shape[1] + 1):
        late = ids > _least(depth < d, ids)
        if not late.any():
            break
        deepest[late & (right >= d)] = d
    least_left, most_left = np.where(deepest > 0, 0, n + length), np.zeros(n, np.int64)
    for o in range(1, length - CORE + 1):
        node = np.cumsum(depth < length - o)
        ok = np.flatnonzero((left >= o) & (right >= length - o))
        if not len(ok):
            continue
        keys = [before[ok, j] for j in range(o)] + [node[ok]]
        by = np.lexsort(keys)
        start = np.ones(len(ok), bool)
        start[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
        at = ok[by][ids[ok][by] > _least(start, ids[ok][by])]
        least_left[at] = np.minimum(least_left[at], o)
        most_left[at] = o
    # One stretch a suffix: its windows follow each other by five words at most, so they leave no hole.
    some = least_left <= length
    end = np.where(deepest > 0, deepest, length - least_left)
    starts, lengths = np.zeros(n, np.int64), np.zeros(n, np.int64)
    starts[order] = suffixes.columns["start"][order] - most_left
    lengths[order] = np.where(some, end + most_left, 0)
    return starts, lengths


def _trees(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        suffixes = Suffixes.joined(Suffixes.unclose(p) for p in pdf["payload"])
        starts, lengths = repeats(suffixes, length)
        at = np.flatnonzero(lengths)
        part, row = suffixes.columns["part"], suffixes.columns["row"]
        at = at[np.argsort(part[at], kind="stable")]
        give_back()
        return pd.DataFrame([(int(p), _answers(row[at[a:b]], starts[at[a:b]], lengths[at[a:b]])) for p, a, b in _groups(part[at])], columns=["part", "payload"])

    return run


def _hot_repeats(found: DataFrame, key: int, heavy: list[np.ndarray], length: int) -> DataFrame:
    """The same where the core is too frequent: the prefix is a whole window, as words. Its least id is aggregated before any exchange, and joined back in salted lots."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for s in _opened(batch):
                s = s.take(np.flatnonzero(_assigned(s, key, heavy)[1] >= len(LADDER)))
                left, right, own = s.left(), s.right(), s.columns
                for o in range(length - CORE + 1):
                    at = np.flatnonzero((left >= o) & (right >= length - o))
                    window = s.codes[at, Suffixes.LEFT - o : Suffixes.LEFT - o + length]
                    text = [b" ".join([s.vocabulary[i] for i in w]) for w in window.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(text, pa.binary()), *[pa.array(own[c][at]) for c in ("id", "part", "row")], pa.array(own["start"][at] - np.int32(o))], ["win", "id", "part", "row", "start"])

    each = stage_table(_pieces(found).mapInArrow(rows, "win binary, id long, part int, row int, start int"), "windows")
    least = each.groupBy("win").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("most > least").drop("most")
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    late = each.withColumn("salt", F.pmod(F.xxhash64("part", "row"), F.lit(SALTS)).cast("int")).join(least, ["win", "salt"]).where("id > least")
    lists = late.groupBy("part").agg(F.collect_list(F.struct("row", "start")).alias("w"))  # no more than a part's own places

    def blobs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [np.array([(x["row"], x["start"]) for x in w]).reshape(-1, 2) for w in pdf["w"]]
            yield pd.DataFrame({"part": pdf["part"], "payload": [_answers(p[:, 0], p[:, 1], np.full(len(p), length)) for p in pairs]})

    return lists.mapInPandas(blobs, "part int, payload binary")


# 5. Removal.


def _removal(with_text: bool):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "n_words", "n_removed", "kept_sha256", *["kept", "removed"] * with_text]
        if not len(left):
            return pd.DataFrame(columns=columns)
        ids, texts = _open(left)
        cuts = np.concatenate([np.frombuffer(b, "<i4").reshape(3, -1) for b in right["payload"]], axis=1) if len(right) else np.zeros((3, 0), np.int32)
        order = np.argsort(cuts[0], kind="stable")
        stretches = {int(r): cuts[1:, order[a:b]] for r, a, b in _groups(cuts[0][order])}
        unpack, again = zstandard.ZstdDecompressor(), {}
        if len(ids) < len(left):  # repeated rows
            for i, z in zip(left["id"], left["z"], strict=True):
                k = (int(i), unpack.decompress(z))
                again[k] = again.get(k, 0) + 1
        out = []
        for low, high in sub_batches(texts):
            for i in range(low, high):
                words = texts[i].split()  # bytes split at ASCII white space, as words are
                n, keep, edges = len(words), None, ()
                if i in stretches:
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, stretches[i][0], 1)
                    np.add.at(cover, stretches[i].sum(axis=0), -1)
                    keep = np.cumsum(cover[:n]) == 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]])))
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                kept = b" ".join(words)
                row = [ids[i], n, n - len(words), hashlib.sha256(kept).hexdigest()]
                if with_text:
                    row += [kept.decode("utf-8", "replace"), [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]]
                out.extend([row] * again.get((int(ids[i]), texts[i]), 1))
        give_back()
        return pd.DataFrame(out, columns=columns)

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP, lot_bytes: int = LOT_BYTES, with_text: bool = False) -> DataFrame:
    """One row per row of ``df``: (id, n_words, n_removed, kept_sha256); if ``with_text`` also the kept words as ``kept`` and the stretches ``removed`` (first word, first after it).

    Words are runs without ASCII white space. A null or empty text has none. Rows with the same id never remove each other's words, and repeated
    rows get the same answer each; null ids count as the greatest. Other columns of ``df`` are not carried. An empty input gives no rows.
    ``length`` is 9 to 13.
    """
    if not CORE < length <= LENGTH:
        raise ValueError("length must be 9 to 13")
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts, bits, key = max(16, size // PART_BYTES), min(28, max(4, int(size // RANGE_BYTES).bit_length())), new_key()
    texts = _parted(docs, parts)
    shared = shared_cores(docs, parts, bits, length, key, lot_bytes)
    found = texts.groupBy("part").cogroup(shared.groupBy("part")).applyInPandas(_suffixes(length, bits, key), "kind int, part int, payload binary")
    found = stage_table(found, "suffixes", PIECES)
    heavy, total = frequent_prefixes(found, key, group)
    dealt = _dealt(found, key, heavy, max(16, total // group))
    cuts = found.where("kind = 2").select("part", "payload").unionByName(dealt.groupBy("task").applyInPandas(_trees(length), "part int, payload binary"))
    if len(heavy) == len(LADDER) and len(heavy[-1]):
        cuts = cuts.unionByName(_hot_repeats(found, key, heavy, length))
    cuts = stage_table(cuts, "stretches")
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, removed array<struct<start:long,end:long>>" * with_text
    done = texts.groupBy("part").cogroup(cuts.groupBy("part")).applyInPandas(_removal(with_text), schema)
    return done.withColumn("id", F.when(F.col("id") != int(_NULL_ID), F.col("id"))).withColumnRenamed("id", id_col)


def op5_suffix_trees(spark, sf_dir: str) -> DataFrame:
    """Every document without the passages of 13 words and more that documents before it have."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP5_SQL = """
WITH split AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM split, unnest(range(1, len(w) - 11)) AS r(i)),
late AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS least FROM windows) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM late, unnest(range(0, 13)) AS r(k)),
words AS (SELECT doc_id, i, w[i] AS word FROM split, unnest(range(1, len(w) + 1)) AS r(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""
