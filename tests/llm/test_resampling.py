import hashlib
import math
import random
import re
import zlib

import pytest

from tallylog.llm.resampling import WordTrie, importance_resample, word_slices

from .data import CLASHES, odd_documents, table, words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, target, longest, buckets, least, percent):
    def features(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = {}, {}
    for side, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for b in features(text):
                side[b] = side.get(b, 0) + 1
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, text, *_ in docs:
        f = features(text)
        gains = [math.floor(1000 * math.log((t.get(b, 0) + 1) * big_s / ((s.get(b, 0) + 1) * big_t))) for b in f]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(plain_words(text))])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k in range(percent * len(order) // 100):
        order[k][4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", *df.columns[-4:])) for r in df.collect()), key=str)


@pytest.mark.parametrize(("longest", "buckets", "least", "percent", "nodes"), [(1, 10_000, 20, 10, 1 << 20), (3, 97, 5, 60, 50), (2, 1000, 1, 100, 1 << 20)])
def test_as_plain_counting(spark, longest, buckets, least, percent, nodes):
    docs = odd_documents()
    docs += [(500, "Élan ÀB straße naïve 12th-x_y " * 9, "fr", "s"), (501, "\x00W1\x7fw2\u0085w3 " * 30, "en", "s")] + [(600, "the same row again and again " * 6, "en", "s")] * 40
    target = [words(random.Random(3), 30, 40) for _ in range(9)] + [None, ""]
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    df = importance_resample(table(spark, docs, clashes=True), aim, longest=longest, buckets=buckets, least_words=least, percent=percent, nodes=nodes)
    assert got(df) == brute(docs, target, longest, buckets, least, percent)
    assert all(r[k] == v for r in df.select(*CLASHES).limit(3).collect() for k, v in CLASHES.items())


@pytest.mark.parametrize("docs", [[], [(1, None, None, None)], [(1, "x " * 25, None, None)] * 30])
def test_few_rows_and_no_target(spark, docs):
    df = importance_resample(table(spark, docs), spark.createDataFrame([], "item_id long, text string"))
    assert got(df) == brute(docs, [], 1, 10_000, 20, 10)


def test_slices_lose_no_word():
    text = " ".join(f"w{i}" for i in range(5000)) + " " + "y" * 3000
    assert [w for s in word_slices(text.encode(), 64) for w in s] == text.encode().split()


def test_states_are_continued():
    trie = WordTrie(3)
    paths = list(trie.walk([b"a", b"bc", b"d"]))
    assert [[trie.states[n] for n in p] for p in paths] == [[zlib.crc32(t) for t in level] for level in ([b"a", b"bc", b"d"], [b"a bc", b"bc d"], [b"a bc d"])]
    assert [len(p) for p in trie.walk([b"d"], [b"a", b"bc"])] == [1, 1, 1]
