import hashlib
import random

import numpy as np
import pytest

from tallylog.llm.suffix_array import END, byte_cores, merged, remove_byte_repeats, short_edges, suffix_order

from .data import odd_documents, table, words


def brute(docs, length):
    least = {}
    data = [(i, (t or "").encode()) for i, t, *_ in docs]
    big = 1 << 63
    for i, t in data:
        for a in range(len(t) - length + 1):
            s = t[a : a + length]
            least[s] = min(least.get(s, big), big if i is None else i)
    out = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - length + 1):
            if least[t[a : a + length]] < (big if i is None else i):
                gone[a : a + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
        out.append((i, len(t), int(gone.sum()), len(spans) // 2, hashlib.sha256(kept).hexdigest(), kept, tuple(zip(spans[::2].tolist(), spans[1::2].tolist(), strict=True))))
    return sorted(out, key=str)


def got(df):
    return sorted(((*tuple(r)[:5], bytes(r[5]), tuple((x["start"], x["end"]) for x in r[6])) for r in df.collect()), key=str)


def some_documents():
    rng = random.Random(4)
    docs = odd_documents()
    docs += [(700, "é" * 200, "fr", "s"), (701, "x" + "é" * 90, "fr", "s"), (702, "=" * 700, "en", "s"), (703, "ab" + "=" * 120 + "cd", "en", "s"), (704, "\x00\x01\n" * 60, "en", "s"), (705, "y\x00\x01\n" * 3 + "\x00\x01\n" * 30, "en", "s")]
    passage = words(rng, 30, 4000)
    docs += [(800 + i, words(rng, rng.randint(0, 9), 4000) + passage[: rng.randint(45, len(passage))] + words(rng, 4, 4000), "en", "s") for i in range(30)]
    docs += [(900 - i, passage[i : i + 50 + i % 3 - 1], "en", "s") for i in range(9)]
    return docs


@pytest.mark.parametrize(("length", "options"), [(50, {}), (50, {"part_bytes": 20_000, "collection_bytes": 5_000, "lot_bytes": 500, "heavy": 4}), (24, {"part_bytes": 50_000}), (61, {"heavy": 0})])
def test_as_brute_force(spark, length, options):
    docs = some_documents()
    df = remove_byte_repeats(table(spark, docs, clashes=True), length=length, with_text=True, **options)
    assert got(df) == brute(docs, length)


@pytest.mark.parametrize("docs", [[], [(1, None, None, None)], [(1, "", "en", "s"), (2, "z" * 49, "en", "s"), (3, "z" * 49, "en", "s")], [(5, "q" * 50, "en", "s")] * 3 + [(None, "q" * 50, "en", "s")] * 2])
def test_few_rows(spark, docs):
    assert got(remove_byte_repeats(table(spark, docs), with_text=True)) == brute(docs, 50)


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_edges_are_those_of_sorted_suffixes(letters):
    rng = np.random.default_rng(letters)
    text = np.concatenate([np.append(rng.integers(0, letters, rng.integers(1, 60)), END) for _ in range(40)]).astype(np.uint8)
    text = np.concatenate([text, text[100:400]])
    ring = text.tobytes() * (2 + 130 // len(text))
    for length in (1, 5, 50, 64):
        order = suffix_order(text, length)
        heads = [ring[i : i + length] for i in order.tolist()]
        assert heads == sorted(heads)
        known = short_edges(text, order, length)
        assert known.tolist() == [True] + [a != b for a, b in zip(heads[1:], heads[:-1], strict=True)] + [True]


def test_cores_hold_all_windows_and_agree():
    rng = random.Random(2)
    text = words(rng, 300).encode()
    data = np.frombuffer(text[:900] + b"\xff" + text[200:1200] + b"\xff" + b"a" * 300 + b"\xff", np.uint8)
    marks, first, windows = byte_cores(data, 50, 7)
    cover = {}
    for m, a, n in zip(marks.tolist(), first.tolist(), windows.tolist(), strict=True):
        for s in range(a, a + n):
            assert s not in cover
            cover[s] = m
    ok = [s for s in range(len(data) - 49) if END not in data[s : s + 50]]
    assert sorted(cover) == ok
    by_text = {}
    for s in ok:
        assert by_text.setdefault(data[s : s + 50].tobytes(), cover[s]) == cover[s]
    assert windows.max() <= 35


def test_stretches_are_merged():
    rows, starts, sizes = merged(np.array([2, 1, 1, 1, 2]), np.array([5, 0, 3, 9, 4]), np.array([5, 3, 2, 1, 3]))
    assert list(zip(rows.tolist(), starts.tolist(), sizes.tolist(), strict=True)) == [(1, 0, 5), (1, 9, 1), (2, 4, 6)]
