import random

import numpy as np
import pytest
from pyspark.sql import Row

from tallylog.llm import neardup
from tallylog.llm.components import connected_components

from .data import CLASHES, odd_documents, table


def brute(docs, threshold=0.8):
    """{(id, text): (class, links, text links)} by comparing all."""
    sets = []
    for i, t, *_ in docs:
        w = [x for x in (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None))
    n = len(docs)
    near = lambda a, b: a is not None and b is not None and len(a & b) >= threshold * len(a | b) - 1e-12
    links = [[j for j in range(n) if j != i and near(sets[i][1], sets[j][1])] for i in range(n)]
    group = list(range(n))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(n):
        for j in links[i]:
            a, b = find(i), find(j)
            group[max(a, b)] = min(a, b)
    out = {}
    for i in range(n):
        members = [sets[j][0] for j in range(n) if find(j) == find(i)]
        out[i] = (min((m for m in members if m is not None), default=None), len(links[i]), len({sets[j][1] for j in links[i]} - {sets[i][1]}))
    return out


def check(spark, docs):
    rows = neardup.near_duplicates(table(spark, docs, clashes=True)).collect()
    want = brute(docs)
    assert sorted(map(str, rows)) == sorted(str(Row(doc_id=docs[k][0], _class_id=v[0], n_links=v[1], n_text_links=v[2])).replace("_class_id", rows[0].__fields__[1]) for k, v in want.items())


def documents(seed, groups, size):
    rng, out = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 80))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            out.append((len(out), " ".join(w), "en", "s"))
    rng.shuffle(out)
    return out


def test_odd_documents(spark):
    check(spark, odd_documents())


def test_null_ids_and_ids_of_several_texts(spark):
    docs = documents(3, 8, 6)
    check(spark, [(None if k % 3 == 0 else i, *rest) for k, (i, *rest) in enumerate(docs)])
    check(spark, [(i % 10, *rest) for i, *rest in documents(4, 10, 5)])
    line = [f"w{i}" for i in range(8)]  # four of five runs in common: exactly the threshold
    check(spark, [(None, " ".join(line), "en", "s"), (5, " ".join([*line, "x"]), "en", "s")])


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    check(spark, documents(seed, 25, 8))


@pytest.mark.parametrize("block, grams", [(4, 2_000_000), (512, 150)])
def test_blocks(spark, monkeypatch, block, grams):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_GRAMS", grams)
    docs = documents(7, 6, 30)
    base = docs[0][1].split()  # lengths about the edges of strips
    docs += [(1000 + k, " ".join(base + [f"t{i}" for i in range(k)]), "en", "s") for k in range(0, 24, 2)]
    check(spark, docs)


def test_edges_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    edges = []
    monkeypatch.setattr(neardup, "BLOCK", 32)
    monkeypatch.setattr(neardup, "connected_components", lambda df, *cols: edges.append(df.count()) or connected_components(df, *cols))
    base = [f"w{i}" for i in range(120)]
    for n in (64, 256):
        check(spark, [(i, " ".join([*base, f"e{i}"]), "en", "s") for i in range(n)])  # all near to all
    (few, few_links), (many, many_links) = edges[:2], edges[2:]
    assert many < 6 * few and many_links < 6 * few_links


def test_blocks_that_meet_keep_every_part():
    rng = np.random.default_rng(5)
    for n in (2, 3, 9, 30):
        for share in (0.02, 0.1, 0.5):
            ok, side = np.triu(rng.random((n, n)) < share, 1), rng.random(n) < 0.5
            within = ok & (side[:, None] == side[None, :])
            whole = neardup._forest(ok)
            apart = neardup._forest(within) + neardup._forest(ok, side)
            assert len(apart) == len(whole) and all(ok[a, b] for a, b in whole + apart)  # forests of one graph have as many edges

            def parts(found, n=n):
                group = list(range(n))
                for a, b in found:
                    group = [group[a] if g == group[b] else g for g in group]
                return [group.index(g) for g in group]

            assert parts(whole) == parts(apart) == parts(np.argwhere(ok))


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_that_collide_modulo_powers_of_two(spark):
    line = [f"w{i}" for i in range(12)]
    docs = [(1, " ".join(line[:6] + [thue_morse(1024, "ab", "ba")] + line[6:]), "en", "s"), (2, " ".join(line[:6] + [thue_morse(1024, "ba", "ab")] + line[6:]), "en", "s")]
    check(spark, docs)
    rows = neardup.near_duplicates(table(spark, docs)).collect()
    assert [r["n_links"] for r in rows] == [0, 0] and len({r["class_id"] for r in rows}) == 2


def test_nothing_in_common(spark):
    assert neardup.near_duplicates(table(spark, [])).collect() == []
    check(spark, [(1, None, None, None), (2, "", "en", "s"), (3, " ", "en", "s")])
    check(spark, [(1, "a b", "en", "s"), (2, "a b", "en", "s"), (3, "a  b\n", "en", "s"), (4, "b a", "en", "s")])


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.99999), (0.7, 0.999), (0.9, 0.9999)):
        bands, rows = neardup.choose_bands(threshold, recall)
        assert bands * rows <= 192 and 1 - (1 - threshold**rows) ** bands >= recall


def test_minhashes_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**64, 2000, dtype=np.uint64))
    b = np.concatenate([a[:1600], rng.integers(0, 2**64, 400, dtype=np.uint64)])
    m = neardup.minhashes([a, np.unique(b), np.zeros(0, np.uint64)], 192)
    assert abs((m[0] == m[1]).mean() - 1600 / 2400) < 0.12 and not m[2].any()


def test_one_of_each_group_stays(spark):
    docs = odd_documents()
    df = table(spark, docs, clashes=True)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    want = {c for i, (c, *_) in brute([d for d in docs if d[0] is not None]).items()}
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted(want)
    assert sum(r["doc_id"] is None for r in rows) == 1 and all(r[k] == v for r in rows for k, v in CLASHES.items())


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (200, 100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}


def test_components_of_hubs_paths_and_chance(spark):
    rng = random.Random(9)
    edges = [(i, 99) for i in range(60, 99)] + [(100 + i, 101 + i) for i in range(33)]  # a hub above its leaves; a path upwards
    edges += [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(45)] + [(300 + 10 * i, 301 + 10 * i + k) for i in range(4) for k in range(9)] + [(309 + 10 * i, 319 + 10 * i) for i in range(3)]
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in least:
        for x, y in edges:
            if x != y:
                least[x] = least[y] = min(least[x], least[y])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == least
