import hashlib
import random

import pytest

from tallylog.llm import substring

from .data import odd_documents, table, words


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(docs, length=13):
    first = {}
    for i, t, *_ in docs:
        w, i = split(t), float("inf") if i is None else i
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in docs:
        w, gone, j = split(t), set(), float("inf") if i is None else i
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < j:
                gone |= set(range(k, k + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def check(spark, docs, **how):
    rows = substring.remove_repeats(table(spark, docs, clashes=True), **how).collect()
    assert sorted((str(r[0]), *r[1:4]) for r in rows) == brute(docs)


def shared(seed, n=40):
    rng = random.Random(seed)
    passages = [words(rng, rng.randint(5, 60), 5000) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [words(rng, rng.randint(0, 30), 5000) for _ in range(rng.randint(1, 4))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            w = p.split()
            a = rng.randrange(len(w))
            parts.insert(rng.randrange(len(parts) + 1), rng.choice([p, " ".join(w[a:]), " ".join(w[:a]), p + " " + p]))
        out.append((rng.randrange(10**6), rng.choice([" ", "\n", " \t"]).join(parts), "en", "s"))
    return out


def test_odd_documents(spark):
    check(spark, odd_documents())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random(spark, seed):
    check(spark, shared(seed))


@pytest.mark.parametrize("group, lot_bytes", [(1, 40), (3, 200), (20, 1000)])
def test_prefixes_grow_and_hot_ones_are_never_gathered(spark, group, lot_bytes):
    check(spark, shared(4) + odd_documents()[60:100], group=group, lot_bytes=lot_bytes)


def test_prefixes_of_several_lengths(spark):
    rng = random.Random(7)
    passages = [f"the same {'old ' * (i % 4)}start " + words(rng, 30, 50) for i in range(12)]
    docs = [(i, words(rng, rng.randint(0, 9), 60) + " " + rng.choice(passages) + " " + words(rng, 5, 60), "en", "s") for i in range(60)]
    for group in (4, 12, 40):
        check(spark, docs, group=group)


def test_a_passage_in_every_document(spark):
    """With the sizes of production: in the first, before and after other words, in the midst, twice."""
    rng = random.Random(8)
    passage = words(rng, 60, 9000)
    check(spark, [(i, f"{words(rng, rng.randint(0, 20), 9000)} {passage} {words(rng, rng.randint(0, 20), 9000)} {passage if i % 7 == 0 else ''}", "en", "s") for i in range(400)])


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048])
def test_words_that_collide_modulo_powers_of_two(spark, n):
    x, y = thue_morse(n, "ab", "ba"), thue_morse(n, "ba", "ab")
    line = [f"w{i}" for i in range(12)]
    docs = [(1, " ".join(line[:6] + [x] + line[6:]), "en", "s"), (2, " ".join(line[:6] + [y] + line[6:]), "en", "s"), (3, " ".join(line[:6] + [x] + line[6:]), "en", "s")]
    check(spark, docs)
    check(spark, docs, group=1)


def test_words_are_compared_even_if_all_hashes_agree(spark, monkeypatch):
    """Trees hold words: with every core equal, nothing is removed but true repeats."""
    import numpy as np

    rng = random.Random(9)
    texts = [words(rng, 16, 5) for _ in range(60)]
    codes, vocabulary = [], {b"": 0}
    for t in texts:
        w = [vocabulary.setdefault(x.encode(), len(vocabulary)) for x in t.split()]
        codes.append(([0] * 5 + w + [0] * substring.PATH)[3 : 3 + 5 + substring.PATH])
    suffixes = substring.Suffixes(np.array(codes, np.int32), list(vocabulary), id=np.arange(60), row=np.arange(60), start=np.zeros(60, np.int64), part=np.zeros(60, np.int64))
    starts, lengths = substring.repeats(suffixes)
    for i, t in enumerate(texts):
        w = t.split()
        shares = any(tuple(w[:13]) == tuple(o.split()[:13]) for o in texts[:i])
        assert bool(lengths[i]) == shares


def test_nodes_have_real_depths():
    import numpy as np

    path = np.array([[1, 2, 3, 0], [1, 2, 3, 4], [1, 2, 5, 0], [2, 0, 0, 0], [2, 0, 0, 0]])
    assert substring.shared_depths(path).tolist() == [0, 3, 2, 0, 1]


def test_rows_of_suffixes_are_small_even_if_a_whole_part_repeats():
    """What a task reads and holds at a time is bounded by rows, not by how much of a part other documents have, too."""
    import numpy as np
    import pandas as pd
    import zstandard

    rng, key, bits = random.Random(11), 5, 4
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(25_000)).encode() for _ in range(16)]
    words_of, first, *_ = substring.word_hashes(texts, key)
    runs, places, owner = substring.cores(words_of, first)
    docs, counts = substring._by_doc(owner)
    left = pd.DataFrame({"part": 3, "id": range(16), "z": [zstandard.ZstdCompressor().compress(t) for t in texts]})
    right = pd.DataFrame({"part": [3], "docs": [docs], "counts": [counts], "keys": [(runs[places] >> np.uint64(32 - bits)).astype("<u8").tobytes()]})
    rows = [p for kind, _, p in substring._suffixes(13, bits, key)(left, right).itertuples(index=False) if kind == 0]
    assert max(map(len, rows)) < 4 << 20
    some = [substring.Suffixes.unclose(p) for p in rows]
    assert max(map(len, some)) <= substring.PIECE and sum(map(len, some)) == len(places) > 3 * substring.PIECE
    assert sorted((i, at) for s in some for i, at in zip(s.columns["id"].tolist(), s.columns["start"].tolist(), strict=True)) == sorted(zip(owner.tolist(), (places - first[owner]).tolist(), strict=True))


def test_suffixes_of_several_parts_go_together():
    """A task deals several rows at once, and each suffix still knows its part, row and words; batches of rows are cut where they hold many."""
    import numpy as np
    import pyarrow as pa

    def made(part, n):
        vocabulary = [b"", *[b"%d.%d" % (part, i) for i in range(9)], b"both"]
        codes = np.random.default_rng(part).integers(0, 11, (n, substring.Suffixes.LEFT + substring.PATH)).astype(np.int32)
        return substring.Suffixes(codes, vocabulary, id=np.arange(n) - 2**40, row=np.arange(n), start=np.arange(n) * 3, part=np.full(n, part))

    def rows(*some):
        return sorted((*[s.columns[k][j].item() for k in ("id", "row", "start", "part")], *[s.vocabulary[i] for i in s.codes[j]]) for s in some for j in range(len(s)))

    some = [made(p, n) for p, n in ((1, 3), (2, 50), (7, 40), (4, 1))]
    batch = pa.RecordBatch.from_arrays([pa.array([s.close() for s in some], pa.binary())], ["payload"])
    assert rows(substring.Suffixes.unclose(substring.Suffixes.joined(some).close())) == rows(*some)
    lots = list(substring._lots(batch, 45))
    assert [len(s) for s in lots] == [53, 41] and rows(*lots) == rows(*some)


def test_repeated_words(spark):
    check(spark, [(i, "a b " * n, "en", "s") for i, n in enumerate((3, 10, 40, 7, 6))] + [(9, "a " * 50, "en", "s"), (10, "a " * 13, "en", "s"), (11, "a " * 12, "en", "s")])


def test_kept_text_and_nothing(spark):
    text = words(random.Random(1), 30, 9000)
    rows = substring.remove_repeats(table(spark, [(1, text, "en", "s"), (2, "x y " + text + " z", "en", "s")]), with_text=True).collect()
    assert {r["doc_id"]: r["kept"] for r in rows} == {1: text, 2: "x y z"}
    assert {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in rows} == {1: [], 2: [(2, 32)]}
    assert substring.remove_repeats(table(spark, [])).collect() == []
    check(spark, [(1, None, None, None), (2, "", "en", "s")])
