"""Hashes of words and of runs of words, vectorised over whole batches of texts.

A word's hash is a sum of its bytes, each times a random 64-bit number of its place (multilinear hashing): whatever two different words are, they meet
with a chance of at most 2**-55, as long as the key is drawn after the texts were written. Operators draw a key for each run.
"""

from __future__ import annotations

import hashlib
import secrets
from functools import lru_cache

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
#: Words of more bytes than this are hashed one by one (keyed BLAKE2b).
LONG_WORD = 256


def new_key() -> int:
    """A key for one run."""
    return secrets.randbits(62)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


@lru_cache(maxsize=4)
def _factors(key: int) -> np.ndarray:
    """A random number for each place in a word."""
    return np.random.Generator(np.random.Philox(key)).integers(0, 1 << 64, LONG_WORD, dtype=_U)


def word_hashes(texts: list[bytes], key: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs without ASCII white space. Of all texts: (hash of each word, first word of each text with the total
    at the end, start and end byte of each word in the joined bytes, the joined bytes)."""
    joined = np.frombuffer(b"\n" + b"".join([t + b"\n" for t in texts]), dtype=np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    hashes, factors, sizes = np.zeros(len(starts), dtype=_U), _factors(key), ends - starts
    low = 0
    while low < len(starts):  # some bytes at a time, as a text may be very long
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + CHUNK, side="right")))
        part, size = joined[starts[low] : ends[high - 1]], sizes[low:high]
        letters = part[~space[starts[low] : ends[high - 1]]]
        at = np.cumsum(size) - size
        place = np.arange(len(letters), dtype=np.int32) - np.repeat(at.astype(np.int32), size)
        with np.errstate(over="ignore"):
            terms = factors.take(place, mode="clip")
            terms *= letters.astype(_U) + _U(1)
            hashes[low:high] = np.add.reduceat(terms, at) >> _U(8)
        low = high
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(joined[starts[i] : ends[i]].tobytes(), digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    text_starts = np.cumsum([1] + [len(t) + 1 for t in texts])
    return mix(hashes), np.searchsorted(starts, text_starts), starts, ends, joined


def run_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of k words: element i is of words i to i + k - 1. Empty if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    out = np.zeros(n, dtype=_U)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += words[j : j + n] * _U((2 * int(mix(np.array([j], dtype=_U), 77)[0]) + 1) & 0xFFFFFFFFFFFFFFFF)
    return mix(out, salt)


#: Bytes of text that are hashed at a time: a worker's arrays are some 50 times as large.
CHUNK = 1 << 19


def byte_slices(column, most: int = CHUNK):
    """(low, high, texts as bytes) over an Arrow column of strings, about ``most`` bytes at a time; nulls are empty. The column as a whole never becomes Python objects."""
    import pyarrow as pa
    import pyarrow.compute as pc

    data = column.cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(data):
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield low, high, [t or b"" for t in data.slice(low, high - low).to_pylist()]
        low = high


def sub_batches(texts: list[bytes], most: int = CHUNK):
    """Slices (low, high) of the list with about ``most`` bytes each; a longer text is alone."""
    low, held = 0, 0
    for i, t in enumerate(texts):
        if i > low and held + len(t) > most:
            yield low, i
            low, held = i, 0
        held += len(t)
    if low < len(texts):
        yield low, len(texts)


def shingle_sets(texts: list[bytes], k: int = 5, key: int = 0) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of k words. A text of 1 to k - 1 words has one, of all its words; one without words none."""
    words, first, _, _, _ = word_hashes(texts, key)
    runs = run_hashes(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(mix(run_hashes(words[a:b], b - a), 1000 + b - a))
        else:
            out.append(np.zeros(0, dtype=_U))
    return out
