import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallylog.llm.packing import WordEncoder, best_fit_pack, best_fit_runs, octaves, pieces, sweep, tokenizer_path

from .data import odd_documents, table


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def test_ids_are_the_tokenizers(tokenizer):
    rng, letters = random.Random(3), "abcdefghijklmnopqrstuvwxyzABCXYZ'.,!?-éèüßñ 0123456789#%&*\"()\t\nĀſǄ"
    texts = ["", "a  b\x1cd　e", "<|endoftext|> x<|startoftext|>y", "İSTANBUL ΣΑΣ don't I'LL 12²½", "é ́x y\x85z\x0bq", "😀 ǅ AB BA"]
    texts += ["".join(rng.choice(letters) for _ in range(200)) for _ in range(100)]
    vocabulary = [w.replace("</w>", "") for w in tokenizer.get_vocab()]
    texts += [" ".join("".join(rng.choice(vocabulary) for _ in range(3)) for _ in range(20)) for _ in range(200)]
    for text, got in zip(texts, WordEncoder(tokenizer_path()).encode_batch(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_are_forgotten_in_time(tokenizer, monkeypatch):
    monkeypatch.setattr("tallylog.llm.packing.CACHED_WORDS", 5)
    encoder, texts = WordEncoder(tokenizer_path()), [f"word{i} other{i} again" for i in range(40)]
    for i in range(0, 40, 3):
        for text, got in zip(texts[i : i + 3], encoder.encode_batch(texts[i : i + 3]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces():
    ids = np.arange(10, dtype="<u4").tobytes()
    cut = pieces(ids, 4)
    assert [x[:3] for x in cut] == [(0, 0, 4), (1, 4, 4), (2, 8, 3)]
    assert cut[2][3] == zlib.crc32(np.array([8, 9, 1], "<u4").tobytes())
    assert pieces(b"", 4) == [(0, 0, 1, zlib.crc32(b"\x01\x00\x00\x00"))]


def naive_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, rng.choice([5, 40, 100])) for _ in range(500)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    fill, used = {}, set()
    plan, gaps, opened = [], [], 0
    for top, low in octaves(100):
        rows, gaps, opened = sweep({k: n for k, n in counts.items() if low <= k <= top}, gaps, opened, 100)
        plan = sorted(plan + rows)
    for k, (length, rank, first, offset) in enumerate(plan):
        end = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == length else counts[length]
        for s in range(first, first + end - rank):
            for at in range(offset, offset + length):
                assert (s, at) not in used
                used.add((s, at))
            fill[s] = fill.get(s, 0) + length
    assert sum(fill.values()) == sum(lengths) and max(fill.values()) <= 100
    assert all((s, at) in used for s, n in fill.items() for at in range(n))
    assert len(fill) == naive_best_fit(lengths, 100)


def test_octaves():
    assert octaves(12) == [(12, 7), (6, 4), (3, 2), (1, 1)] and octaves(1) == [(1, 1)]


@pytest.mark.parametrize("stripes", [1, 3])
def test_supersteps_are_best_fit(spark, stripes):
    rng = random.Random(9)
    lengths = [rng.randint(1, rng.choice([4, 30, 64])) for _ in range(600)]
    rows = [(s, n, lengths.count(n) // stripes + (s < lengths.count(n) % stripes)) for n in set(lengths) for s in range(stripes)]
    found = best_fit_runs(spark.createDataFrame([r for r in rows if r[2]], "stripe long, length long, n long"), 64).collect()
    used = set()
    for r in found:
        n = next(x[2] for x in rows if x[:2] == (r["stripe"], r["length"]))
        ends = [p["rank"] for p in r["places"][1:]] + [n]
        for p, end in zip(r["places"], ends, strict=True):
            for k in range(end - p["rank"]):
                spots = {(r["stripe"], p["first"] + k, p["offset"] + i) for i in range(r["length"])}
                assert not spots & used and p["offset"] + r["length"] <= 64
                used |= spots
    assert len(used) == sum(lengths)
    n = len({x[:2] for x in used})
    assert n == naive_best_fit(lengths, 64) if stripes == 1 else n <= naive_best_fit(lengths, 64) + stripes


@pytest.mark.parametrize("stripe", [4_000_000, 40])
def test_packing_whole(spark, tokenizer, stripe):
    docs = odd_documents()
    rows = best_fit_pack(table(spark, docs, clashes=True), capacity=256, stripe=stripe).collect()
    want = []
    for i, text, _, _ in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes())) for k in range(0, len(ids), 256)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in rows)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    least = naive_best_fit([r["length"] for r in rows], 256)
    assert len(sequences) == least if stripe > 1000 else least <= len(sequences) <= least + len(rows) // stripe


def test_nothing(spark):
    assert best_fit_pack(table(spark, [])).collect() == []
