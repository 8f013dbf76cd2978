"""Substring deduplication of bytes: common prefixes from Burrows-Wheeler transforms, by threshold-bounded interval expansion.

Every byte that is covered by a string of ``length`` bytes which also starts in a document with a smaller id is removed.

1. *Which places can repeat.* In each window of ``length`` bytes the least hash among its runs of ``CORE`` bytes is its core; equal windows have equal cores at the same place. A core that only
   one document has has no repeat around it and is dropped: exact in one direction (a chance agreement of hashes keeps a core too many, and never loses one). Cores are exchanged by ranges of
   their hash, in lots of ``LOT_BYTES``, each of which reports only its cores' least and greatest documents and their number.
2. *Fragments.* Neighbouring windows with the same core make a fragment, at most 2 ``length`` - ``CORE`` bytes. Fragments go to the collection that their core's hash names, so that equal windows meet.
   Within a part of the corpus equal fragments go as one, from the least id; the others are settled on the spot.
3. *Suffixes.* A task joins a collection's different fragments, each with an end mark (a byte that UTF-8 never has), sorts the suffixes by their first ``length`` bytes and more (ranks of 8, 16,
   32 ... bytes), and takes the byte before each: the transform.
4. *Interval expansion.* Edges between suffixes that share no byte are known: where first bytes change. Breadth-first, each edge known to have a common prefix of v bytes opens the interval up to the
   next known edge; prepending each byte that occurs in it, a step backwards in the transform, leads to an edge of v + 1, new unless known to have less. All intervals of one v go at once, as arrays.
   It stops at ``length`` - 1. The edges left unknown stand inside classes of windows with the same ``length`` bytes; of each class all go but those of the least id.
5. *Removal.* Stretches return to their documents, whose covered bytes go.

Parts, ranges and collections grow in number with the bytes of the corpus, and so stay of one size. A core that more than ``HEAVY`` documents have isn't gathered: its windows' least id is
aggregated as rows, before any exchange, and joined back in salted lots.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table
from .shingles import byte_slices, mix, new_key, sub_batches
from .substring import _NULL_ID, _by_doc, _groups, _listed, _pack, _unpack, part_of

LENGTH, CORE = 50, 16
#: Bytes of text for each part of the documents, for each range of cores and for each collection of fragments; bytes of cores in a lot; bytes that are hashed at a time.
PART_BYTES, RANGE_BYTES, COLLECTION_BYTES, LOT_BYTES, SEGMENT = 8 << 20, 10 << 20, 1 << 20, 8 << 20, 1 << 19
#: Documents that a core may have before its windows are aggregated as rows; lots for these.
HEAVY, SALTS = 1 << 16, 32
#: Ends a fragment or a text: UTF-8 has no such byte.
END = 0xFF
_U = np.uint64
_FACTOR = _U(0x9E3779B97F4A7C15)


# 1. Cores that several documents have.


def _loaded(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each place on as one number."""
    return np.lib.stride_tricks.sliding_window_view(data, 8).copy().view(kind).ravel()


def byte_cores(data: np.ndarray, length: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the core, first window, windows) of each run of neighbouring windows with one core. Windows don't reach over an ``END``; ``data`` is under 2**24 bytes."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    eight, m = _loaded(data), len(data) - CORE + 1
    marks = np.full(m, key, _U)
    for o in range(0, CORE, 8):
        marks ^= eight[o : o + m]
        marks *= _FACTOR
        marks ^= marks >> _U(29)
    marks *= _FACTOR
    best = (marks & ~_U(0xFFFFFF)) | np.arange(m, dtype=_U)
    span, wide = 1, length - CORE + 1
    while 2 * span <= wide:
        best, span = np.minimum(best[:-span], best[span:]), 2 * span
    if span < wide:
        best = np.minimum(best[: span - wide], best[wide - span :])
    ends = np.concatenate([[0], np.cumsum(data == END)])
    window = np.flatnonzero(ends[length:] == ends[:n])
    place = (best[window] & _U(0xFFFFFF)).astype(np.int64)
    at = np.flatnonzero(np.diff(place, prepend=-1))
    return marks[place[at]], window[at], np.diff(np.append(at, len(place)))


def _segments(texts: list[bytes], length: int, key: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some bytes at a time: (hashes of cores, numbers of their texts, places of the first windows in these, windows, joined bytes, first windows in the joined bytes)."""
    joined = np.frombuffer(b"".join([t + b"\xff" for t in texts]), np.uint8)
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    for low in range(0, len(joined), SEGMENT):
        marks, start, windows = byte_cores(joined[low : low + SEGMENT + length - 1], length, key)
        start = start + low
        owner = np.searchsorted(first, start, side="right") - 1
        yield marks, owner, start - first[owner], windows, joined, start


def _core_lists(df: DataFrame, bits: int, length: int, key: int) -> DataFrame:
    """(range, docs, counts, keys) rows: for each hash range, the cores that a batch has there, four bytes each."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
            found, doc = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
            for low, high, texts in byte_slices(batch.column(1)):
                for marks, owner, *_ in _segments(texts, length, key):
                    found.append(marks >> _U(32 - bits))
                    doc.append(ids[low:high][owner])
            found, doc = np.concatenate(found), np.concatenate(doc)
            order = np.lexsort((found, doc, found >> _U(32)))
            found, doc = found[order], doc[order]
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
            found, doc = found[new], doc[new]
            rows = [(int(r), *_by_doc(doc[a:b]), found[a:b].astype("<u4").tobytes()) for r, a, b in _groups((found >> _U(32)).astype(np.int64))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)]], ["range", "docs", "counts", "keys"])

    return df.mapInArrow(run, "range int, docs binary, counts binary, keys binary")


def _ends_of(keys: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, with the least and the greatest document and the number of documents."""
    order = np.argsort(keys, kind="stable")
    at = np.flatnonzero(np.diff(keys[order], prepend=~keys[order][:1]))
    return keys[order][at], np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at), np.add.reduceat(n[order], at)


_ENDS = {"keys": "<u4", "low": "<i8", "high": "<i8", "n": "<u4"}


def _lot_ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """The ends of a lot's cores; of those of several documents only, where the lot is all of its range."""
    doc, keys = _listed(pdf)
    found = _ends_of(keys, doc, doc, np.ones(len(doc), np.int64))
    if pdf["lots"].iloc[0] == 1:
        several = found[1] < found[2]
        found = [v[several] for v in found]
    return pd.DataFrame({"range": [pdf["range"].iloc[0]]} | {c: [_pack(v.astype(kind))] for (c, kind), v in zip(_ENDS.items(), found, strict=True)})


def _two_docs(heavy: int):
    """The cores of a range that several documents have, and which of them too many."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, low, high, n = _ends_of(*[np.concatenate([_unpack(b, kind) for b in pdf[c]]) for c, kind in _ENDS.items()])
        several = low < high
        return pd.DataFrame({"range": [pdf["range"].iloc[0]], "shared": [_pack(keys[several])], "heavy": [_pack(keys[several & (n > heavy)])]})

    return run


def _return_cores(parts: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"part": [], "heavy": [], "docs": [], "counts": [], "keys": []})
        doc, keys = _listed(left)
        keep = np.isin(keys, _unpack(right["shared"].iloc[0], "<u4"))
        doc, keys = doc[keep], keys[keep]
        heavy = np.isin(keys, _unpack(right["heavy"].iloc[0], "<u4"))
        keys = keys.astype(_U) | (_U(int(left["range"].iloc[0])) << _U(32))
        part = part_of(doc, parts) * 2 + heavy
        order = np.lexsort((keys, doc, part))
        doc, keys, part = doc[order], keys[order], part[order]
        rows = [(int(p) // 2, int(p) % 2, *_by_doc(doc[a:b]), zlib.compress(keys[a:b].astype("<u8").tobytes(), 1)) for p, a, b in _groups(part)]
        return pd.DataFrame(rows, columns=["part", "heavy", "docs", "counts", "keys"])

    return run


def shared_cores(docs: DataFrame, parts: int, bits: int, length: int, key: int, lot_bytes: int, heavy: int) -> DataFrame:
    """(part, heavy, docs, counts, keys): the documents of each part and their cores that another document has, too."""
    held = stage_table(_core_lists(docs, bits, length, key), "cores")
    lots = held.groupBy("range").agg(F.ceil(F.sum(F.octet_length("keys")) / lot_bytes).cast("int").alias("lots"))
    dealt = held.join(lots, "range").withColumn("lot", F.pmod(F.xxhash64("docs", "keys"), F.col("lots")).cast("int"))
    ends = dealt.groupBy("range", "lot").applyInPandas(_lot_ends, "range int, keys binary, low binary, high binary, n binary")
    shared = ends.groupBy("range").applyInPandas(_two_docs(heavy), "range int, shared binary, heavy binary")
    each = shared.join(lots, "range").select("range", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "shared", "heavy")
    return dealt.groupBy("range", "lot").cogroup(each.groupBy("range", "lot")).applyInPandas(_return_cores(parts), "part int, heavy int, docs binary, counts binary, keys binary")


# 2. Fragments.

#: Bytes of texts that are bundled by part at a time.
BUNDLE_BYTES = 32 << 20


def _bundled(df: DataFrame, parts: int) -> DataFrame:
    """(part, bundle): ids, sizes and compressed texts of the documents of a batch that are in a part."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def close(held: list) -> pa.RecordBatch:
            ids, texts = np.concatenate([i for i, _ in held]), [t for _, some in held for t in some]
            part, pack, rows = part_of(ids, parts), zstandard.ZstdCompressor(level=3), []
            order = np.argsort(part, kind="stable")
            for p, a, b in _groups(part[order]):
                some = [texts[i] for i in order[a:b]]
                head = np.concatenate([[b - a], ids[order[a:b]], [len(t) for t in some]]).astype("<i8")
                rows.append((int(p), head.tobytes() + pack.compress(b"".join(some))))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "bundle"])

        for batch in batches:
            ids, held, size = batch.column(0).fill_null(_NULL_ID).to_numpy(zero_copy_only=False), [], 0
            for low, high, texts in byte_slices(batch.column(1)):
                held.append((ids[low:high], texts))
                size += sum(map(len, texts))
                if size > BUNDLE_BYTES:
                    yield close(held)
                    held, size = [], 0
            if held:
                yield close(held)

    return df.mapInArrow(run, "part int, bundle binary")


def _open(left: pd.DataFrame) -> tuple[np.ndarray, list[bytes], list[int]]:
    """Ids and texts of a part in a fixed order, each different row once, and how often it is there."""
    unpack, rows = zstandard.ZstdDecompressor(), Counter()
    for bundle in left["bundle"]:
        n = int(np.frombuffer(bundle[:8], "<i8")[0])
        head = np.frombuffer(bundle[8 : 8 + 16 * n], "<i8")
        data = unpack.decompress(bundle[8 + 16 * n :])
        ends = np.cumsum(head[n:]).tolist()
        rows.update(zip(head[:n].tolist(), [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
    order = sorted(rows)
    return np.array([i for i, _ in order], dtype=np.int64), [t for _, t in order], [rows[r] for r in order]


class Fragments:
    """Bytes of different fragments (a row each, filled up with ``END``), and the places they are from: number of the fragment, id, part, row of the part, place in the text."""

    PLACES = {"of": "<u4", "id": "<i8", "row": "<u4", "start": "<u4"}

    def __init__(self, data: np.ndarray, part: np.ndarray, **places: np.ndarray) -> None:
        self.data, self.part, self.places = data, part, places

    def sizes(self) -> np.ndarray:
        return (self.data != END).sum(axis=1)

    def take(self, at: np.ndarray) -> Fragments:
        """Some places, with the fragments they need in the order in which they come: of places in the order of texts, numbers hardly need room then."""
        used, first, of = np.unique(self.places["of"][at], return_index=True, return_inverse=True)
        order = np.argsort(first)
        number = np.empty(len(used), np.int64)
        number[order] = np.arange(len(used))
        return Fragments(self.data[used[order]], self.part[at], **{k: number[of] if k == "of" else v[at] for k, v in self.places.items()})

    @classmethod
    def joined(cls, some: list[Fragments]) -> Fragments:
        """All together, equal fragments as one (two that are equal may be left apart where hashes meet; that changes no result)."""
        data = np.concatenate([s.data for s in some])
        base = np.cumsum([0] + [len(s.data) for s in some])
        of = np.concatenate([s.places["of"] + b for s, b in zip(some, base, strict=False)])
        marks = np.zeros(len(data), _U)
        for c in np.ascontiguousarray(data).view("<u8").T:
            marks = mix(marks ^ c)
        order = np.argsort(marks, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = (data[order[1:]] != data[order[:-1]]).any(axis=1)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        places = {k: np.concatenate([s.places[k] for s in some]) for k in cls.PLACES if k != "of"}
        return cls(data[order[new]], np.concatenate([s.part for s in some]), of=number[of], **places)

    def least(self) -> np.ndarray:
        """The least id of each fragment."""
        out = np.full(len(self.data), _NULL_ID)
        np.minimum.at(out, self.places["of"], self.places["id"])
        return out

    def close(self) -> bytes:
        """Compressed, of one part."""
        planes = [np.ascontiguousarray(self.places[k], dtype=kind).view(np.uint8).reshape(len(self.part), -1).T.tobytes() for k, kind in self.PLACES.items()]
        raw = self.data[self.data != END].tobytes() + self.sizes().astype(np.uint8).tobytes() + b"".join(planes)
        return np.array([len(self.data), len(self.part), self.part[0], self.data.shape[1]], "<i8").tobytes() + zstandard.ZstdCompressor(level=3).compress(raw)

    @classmethod
    def unclose(cls, payload: bytes) -> Fragments:
        kinds, n, part, width = np.frombuffer(payload[:32], "<i8").tolist()
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[32:]), np.uint8)
        at = len(raw) - sum(int(k[2]) for k in cls.PLACES.values()) * n - kinds
        data = np.full((kinds, width), END, np.uint8)
        data[np.arange(width) < raw[at : at + kinds, None]] = raw[:at]
        places, at = {}, at + kinds
        for k, kind in cls.PLACES.items():
            step = n * int(kind[2])
            places[k] = np.ascontiguousarray(raw[at : at + step].reshape(-1, n).T).view(kind).ravel().astype(np.int64)
            at += step
        return cls(data, np.full(n, part), **places)


def merged(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of rows, those that overlap or touch as one."""
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order], starts[order], (starts + sizes)[order]
    shift = rows * (int(ends.max(initial=0)) + 2)  # rows apart, so that one running maximum does
    reach = np.maximum.accumulate(ends + shift)
    new = np.ones(len(rows), bool)
    new[1:] = (starts + shift)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return rows[at], starts[at], (reach[np.append(at[1:], len(rows)) - 1] - shift[at] - starts[at]) if len(at) else starts[at]


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are among ``some``, which are sorted."""
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values if len(some) else np.zeros(len(values), bool)


def _answers(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> bytes:
    return _pack(np.stack(merged(rows.astype(np.int64), starts.astype(np.int64), sizes.astype(np.int64))).astype("<u4").ravel())


def _fragments(length: int, bits: int, key: int, collections: int):
    """For cogroups of (documents of a part, its cores): rows (kind, part, task, payload); kind 0: fragments for a collection, 1: of heavy cores, 2: stretches settled (these two only go along)."""
    width = -(-(2 * length - CORE) // 8) * 8
    columns = ["kind", "part", "task", "payload"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in columns})
        part = int(left["part"].iloc[0])
        ids, texts, _ = _open(left)
        wanted = []
        for h in (0, 1):
            some = right[right["heavy"] == h]
            doc = np.concatenate([np.zeros(0, np.int64), *[np.repeat(_unpack(d, "<i8"), _unpack(c, "<u4")) for d, c in zip(some["docs"], some["counts"], strict=True)]])
            wanted.append(np.unique(mix(doc.view(_U), 8) ^ np.concatenate([np.zeros(0, _U), *[np.frombuffer(zlib.decompress(k), "<u8") for k in some["keys"]]])))
        span, made = np.arange(width), []
        for low, high in sub_batches(texts):
            for marks, owner, start, windows, joined, at in _segments(texts[low:high], length, key):
                own = mix(ids[low:high][owner].view(_U), 8) ^ (marks >> _U(32 - bits))
                kind = np.where(_among(own, wanted[0]), 0, np.where(_among(own, wanted[1]), 1, 2))
                k = np.flatnonzero(kind < 2)
                size = windows[k] + length - 1
                if not len(k):
                    continue
                low_, high_ = int(at[k[0]]), int(at[k[-1]]) + width
                near = joined[low_:high_]
                near = np.concatenate([near, np.full(high_ - low_ - len(near), END, np.uint8)])
                data = np.lib.stride_tricks.sliding_window_view(near, width)[at[k] - low_]
                data[span >= size[:, None]] = END
                made.append((data, kind[k], (mix(marks[k], 3) % _U(collections)).astype(np.int64), ids[low:high][owner[k]], owner[k] + low, start[k]))
        if not made:
            return pd.DataFrame({c: [] for c in columns})
        data, kind, task, own, row, start = (np.concatenate(x) for x in zip(*made, strict=True))
        found = Fragments.joined([Fragments(data, np.full(len(own), part), of=np.arange(len(own)), id=own, row=row, start=start)])
        late = found.places["id"] > found.least()[found.places["of"]]
        out = []
        if late.any():
            out.append((2, part, part % collections, _answers(row[late], start[late], found.sizes()[found.places["of"][late]])))
        go = np.flatnonzero(~late)
        go = go[np.lexsort((start[go], row[go], task[go], kind[go]))]
        for t, a, b in _groups((kind * collections + task)[go]):
            out.append((int(t) // collections, part, int(t) % collections, found.take(go[a:b]).close()))
        return pd.DataFrame(out, columns=columns)

    return run


# 3. and 4. Suffixes and their common prefixes.


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` in the order of what begins there, by ``depth`` bytes or more, the text being a ring: by as many bytes as one number holds, then by ranks and the ranks that far behind.

    Keys and places are sorted as one number of 64 bits, where they fit it, which is several times faster than sorting places by keys.
    """
    n = len(text)
    bits = max(1, int(n - 1).bit_length())
    there = np.flatnonzero(np.bincount(text, minlength=256))
    letters = max(2, len(there))
    code = np.zeros(256, _U)
    code[there] = np.arange(len(there), dtype=_U)
    known = 1
    while letters ** (known + 1) <= 1 << (64 - bits):
        known += 1
    ring = np.resize(code[text], n + known - 1)
    key = ring[:n].copy()
    for k in range(1, known):
        key *= _U(letters)
        key += ring[k : k + n]
    while True:
        if int(key.max()) >> (64 - bits):
            order = np.argsort(key)
            ranked = key[order]
        else:
            both = np.sort((key << _U(bits)) | np.arange(n, dtype=_U))
            order, ranked = (both & _U((1 << bits) - 1)).astype(np.int64), both >> _U(bits)
        if known >= depth:
            return order
        rank = np.empty(n, _U)
        rank[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]]), dtype=np.int32).astype(_U)
        key = (rank << _U(bits)) | np.concatenate([rank[known % n :], rank[: known % n]])
        known *= 2


def short_edges(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Where suffix i shares fewer than ``length`` bytes with suffix i - 1, for suffixes in an order by ``length`` bytes or more; and True at the end.

    Value by value: the edges of value v are the starts of intervals that share v bytes and end where the next edge of at most v is. What stands before the suffixes of such an interval, byte by
    byte, leads to the starts of intervals of v + 1 bytes. Only a byte's first occurrence in the interval matters.
    """
    n = len(text)
    before = text[order - 1]  # the transform
    by = np.argsort(before, kind="stable").astype(np.int32)
    back = np.empty(n, np.int32)  # the suffix that is longer by the byte before
    back[by] = np.arange(n, dtype=np.int32)
    same = before[by[1:]] == before[by[:-1]]
    last = np.full(n, -1, np.int32)  # where the same byte occurred last
    last[by[1:][same]] = by[:-1][same]
    active = np.concatenate([[0], np.flatnonzero(~same) + 1]).astype(np.int32)
    known = np.zeros(n + 1, bool)
    known[active] = known[n] = True
    for _ in range(length - 1):
        size = _until_known(known, active) - active
        ends = np.cumsum(size)
        at = np.arange(ends[-1], dtype=np.int32)
        at += np.repeat(active - ends.astype(np.int32) + size, size)
        to = back[at[last[at] < np.repeat(active, size)]]
        active = np.sort(to[~known[to]])
        if not len(active):
            break
        known[active] = True
    return known


def _until_known(known: np.ndarray, active: np.ndarray) -> np.ndarray:
    """The first known edge behind each active one. Where few are active, most intervals are short, and some edges ahead are looked at; else all are listed."""
    ends = np.empty(len(active), np.int32)
    left = np.arange(len(active))
    if 16 * len(active) < len(known):
        for wide in (8, 128):
            if len(known) <= wide:
                break
            begin = np.minimum(active[left] + 1, len(known) - wide)  # a window further back begins with what lies before: skipped below
            ahead = np.lib.stride_tricks.sliding_window_view(known, wide)[begin]
            skipped = active[left] + 1 - begin
            if skipped.any():
                ahead &= np.arange(wide) >= skipped[:, None]
            at = ahead.argmax(axis=1)
            found = ahead[np.arange(len(left)), at]
            ends[left[found]] = (begin + at)[found]
            left = left[~found]
            if not len(left):
                return ends
    edges = np.flatnonzero(known)
    ends[left] = edges[np.searchsorted(edges, active[left], side="right")]
    return ends


def repeats(found: Fragments, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place's number, start in its text, size) of the stretches whose windows a document with a smaller id has, too."""
    sizes, least = found.sizes(), found.least()
    first = np.cumsum(sizes + 1) - sizes - 1
    text = np.full(int((sizes + 1).sum()), END, np.uint8)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    inner = np.arange(len(text)) - first[owner]
    text[inner < sizes[owner]] = found.data[found.data != END]
    window = inner + length <= sizes[owner]
    order = suffix_order(text, length)
    known = short_edges(text, order, length)[:-1]
    ids = np.where(window, least[owner], _NULL_ID)[order]
    starts = np.flatnonzero(known)
    late = np.zeros(len(text), bool)
    late[order] = ids > np.minimum.reduceat(ids, starts)[np.cumsum(known) - 1]
    late &= window
    edge = np.flatnonzero(np.diff(late, prepend=False, append=False))  # windows of two fragments never touch
    begin, end = edge[::2], edge[1::2]
    runs = np.bincount(owner[begin], minlength=len(sizes))
    of, own = found.places["of"], found.places["id"]
    whole = np.flatnonzero(own > least[of])
    some = np.flatnonzero(own == least[of])
    n = runs[of[some]]
    each = np.repeat(some, n)
    ahead = np.cumsum(runs) - runs
    k = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + ahead[of[each]]
    at = np.concatenate([whole, each])
    start = np.concatenate([np.zeros(len(whole), np.int64), inner[begin[k]]]) + found.places["start"][at]
    return at, start, np.concatenate([sizes[of[whole]], end[k] - begin[k] + length - 1])


def _collection(length: int):
    """For groups of one task: rows (kind, part, payload) with the stretches of its fragments; rows of other kinds as they are."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        others = pdf.loc[pdf["kind"] > 0, ["kind", "part", "payload"]]
        payloads = pdf.loc[pdf["kind"] == 0, "payload"]
        if not len(payloads):
            return others
        found = Fragments.joined([Fragments.unclose(p) for p in payloads])
        at, start, size = repeats(found, length)
        order = np.argsort(found.part[at], kind="stable")
        at, start, size = at[order], start[order], size[order]
        row = found.places["row"][at]
        rows = [(2, int(p), _answers(row[a:b], start[a:b], size[a:b])) for p, a, b in _groups(found.part[at])]
        return pd.concat([others, pd.DataFrame(rows, columns=["kind", "part", "payload"])]) if rows else others

    return run


def _heavy_repeats(found: DataFrame, length: int) -> DataFrame:
    """The same for cores that too many documents have: windows as rows, their least id aggregated before any exchange and joined back in salted lots."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["payload"]:
                f = Fragments.unclose(p)
                sizes = f.sizes()
                for o in range(f.data.shape[1] - length + 1):
                    at = np.flatnonzero(sizes[f.places["of"]] >= o + length)
                    if len(at):
                        text = [r.tobytes() for r in f.data[f.places["of"][at], o : o + length]]
                        yield pd.DataFrame({"win": text, "id": f.places["id"][at], "part": f.part[at], "row": f.places["row"][at], "start": f.places["start"][at] + o})

    each = stage_table(found.where("kind = 1").select("payload").mapInPandas(rows, "win binary, id long, part int, row long, start long"), "windows")
    least = each.groupBy("win").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("most > least").drop("most")
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    late = each.withColumn("salt", F.pmod(F.xxhash64("part", "row"), F.lit(SALTS)).cast("int")).join(least, ["win", "salt"]).where("id > least")
    lists = late.groupBy("part").agg(F.collect_list(F.struct("row", "start")).alias("w"))  # no more than a part's own places

    def blobs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [np.array([(x["row"], x["start"]) for x in w], np.int64).reshape(-1, 2) for w in pdf["w"]]
            yield pd.DataFrame({"part": pdf["part"], "payload": [_answers(p[:, 0], p[:, 1], np.full(len(p), length)) for p in pairs]})

    return lists.mapInPandas(blobs, "part int, payload binary")


# 5. Removal.


def _removal(with_text: bool):
    columns = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept", "removed"] * with_text]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=columns)
        ids, texts, often = _open(left)
        cuts = np.concatenate([np.zeros((3, 0), np.int64), *[_unpack(b, "<u4").reshape(3, -1).astype(np.int64) for b in right["payload"]]], axis=1)
        rows, starts, sizes = merged(*cuts)
        stretches = {int(r): (a, b) for r, a, b in _groups(rows)}
        out = []
        for i, text in enumerate(texts):
            a, b = stretches.get(i, (0, 0))
            spans = list(zip(starts[a:b].tolist(), (starts[a:b] + sizes[a:b]).tolist(), strict=True))
            edges = [0, *[x for s in spans for x in s], len(text)]
            kept = b"".join([text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)])
            row = [ids[i], len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()]
            if with_text:
                row += [kept, [{"start": x, "end": y} for x, y in spans]]
            out.extend([row] * often[i])
        return pd.DataFrame(out, columns=columns)

    return run


def remove_byte_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False,
    part_bytes: int = PART_BYTES, collection_bytes: int = COLLECTION_BYTES, lot_bytes: int = LOT_BYTES, heavy: int = HEAVY,
) -> DataFrame:
    """One row per row of ``df``: (id, n_bytes, n_removed, n_spans, kept_sha256); if ``with_text`` also the bytes kept as ``kept`` (a character may have lost a byte) and the stretches ``removed``
    (first byte, first after it; they neither overlap nor touch).

    A null or empty text has no bytes. Rows with the same id never remove each other's bytes, and repeated rows get the same answer each; null ids count as the greatest. Ids are whole numbers
    below 2**63 - 1. Matches never cross documents. Very long texts are hashed in segments, and one text is held whole by a task. Other columns of ``df`` are not carried, so none can clash.
    An empty input gives no rows. ``length`` is 24 to 120.
    """
    if not 24 <= length <= 120:
        raise ValueError("length must be 24 to 120")
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts, bits, key = max(16, size // part_bytes), min(28, max(4, int(size // RANGE_BYTES).bit_length())), new_key()
    texts = _bundled(docs, parts)
    shared = shared_cores(docs, parts, bits, length, key, lot_bytes, heavy)
    found = texts.groupBy("part").cogroup(shared.groupBy("part")).applyInPandas(_fragments(length, bits, key, max(16, size // collection_bytes)), "kind int, part int, task int, payload binary")
    found = stage_table(found.groupBy("task").applyInPandas(_collection(length), "kind int, part int, payload binary"), "stretches")
    cuts = found.where("kind = 2").select("part", "payload")
    if not found.where("kind = 1").isEmpty():
        cuts = cuts.unionByName(stage_table(_heavy_repeats(found, length), "heavy"))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, removed array<struct<start:long,end:long>>" * with_text
    done = texts.groupBy("part").cogroup(cuts.groupBy("part")).applyInPandas(_removal(with_text), schema)
    return done.withColumn("id", F.when(F.col("id") != int(_NULL_ID), F.col("id"))).withColumnRenamed("id", id_col)


def op12_interval_expansion(spark, sf_dir: str) -> DataFrame:
    """Every document without the strings of 50 bytes that documents before it have."""
    return remove_byte_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP12_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, j, substr(h, 512 * j + 1, 612) AS s, (length(h) - 512 * j) // 2 AS more FROM docs, unnest(range(0, (length(h) + 511) // 512)) AS t(j)),
bytes AS (SELECT doc_id, 256 * j + k AS i, substr(s, 2 * k + 1, 2) AS b, CASE WHEN 2 * k + 100 <= length(s) THEN md5(substr(s, 2 * k + 1, 100)) END AS w FROM blocks, unnest(range(0, least(256, more))) AS r(k)),
late AS (SELECT *, w IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY w) AS late FROM bytes),
gone AS (SELECT doc_id, i, b, max(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM late),
spans AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM gone),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n, count(*) FILTER (head) AS s, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS k FROM spans GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(s, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)
"""
