import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallylog.llm.manifest import fold, merkle_manifest, siblings, tree_levels

from .data import CLASHES, odd_documents, table

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fanout):
    """All levels of one tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def path_of(levels, i, fanout):
    out = []
    for nodes in levels[:-1]:
        a = i // fanout * fanout
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + fanout])))
        i //= fanout
    return out


def brute(docs, fanout, change=lambda text: text):
    groups = {}
    for i, text, lang, source in docs:
        n = None if text is None else len(text)
        leaf, other = (leaf_of((i, source, lang, n, t)) for t in (text, None if text is None else change(text)))
        groups.setdefault((lang is not None, (lang or "").encode()), []).append((i is None, i or 0, leaf, other, i))
    names = sorted(groups)
    for rows in groups.values():
        rows.sort(key=lambda r: r[:3])
    trees = [climb([r[2] for r in groups[g]], fanout) for g in names]
    top = climb([t[-1][0] for t in trees], fanout)
    out = []
    for k, g in enumerate(names):
        for j, (_, _, leaf, other, i) in enumerate(groups[g]):
            path = path_of(trees[k], j, fanout) + path_of(top, k, fanout)
            folded = other
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((i, leaf, trees[k][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), folded, folded == top[-1][0], tuple(path)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r[0], *[r[c] for c in df.columns[1:7]], tuple((x["left"], x["right"]) for x in r[7])) for r in df.collect()), key=str)


def some():
    docs = odd_documents()
    return [(i, t, (None, "en", "de", "fr", "", "ß", "~", "a b")[(0 if i is None else i) ** 2 % 8], s) for i, t, _, s in docs] + [(900 + i, f"Text {i}", "en", None) for i in range(70)] + [(77, "Same row", "en", "s")] * 5


@pytest.mark.parametrize(("fanout", "levels"), [(8, 4), (2, 1), (3, 2)])
def test_as_plain_trees(spark, fanout, levels):
    docs, change = some(), F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = merkle_manifest(table(spark, docs), COLUMNS, changed={"text": change}, fanout=fanout, levels=levels, with_proof=True)
    rows = got(df)
    assert rows == brute(docs, fanout, lambda t: t.translate({c: c + 32 for c in range(65, 91)}))
    assert {r[6] for r in rows} == {True, False}
    for r in rows:
        assert (fold(r[1].encode(), [(a.encode(), b.encode()) for a, b in r[7]]).decode()) == r[3]


@pytest.mark.parametrize("docs", [[], [(1, None, None, None)], [(3, "x", "en", "s"), (2, "y", "en", "s")], [(1, "x", None, "s")] * 20])
def test_few_rows(spark, docs):
    assert got(merkle_manifest(table(spark, docs), COLUMNS, with_proof=True)) == brute(docs, 8)


def test_other_columns_stay(spark):
    df = table(spark, odd_documents(), clashes=True).withColumn("leaf", F.lit(1)).withColumn("_g", F.lit(2))
    out = merkle_manifest(df, COLUMNS, carry=["doc_id", "leaf", "_g", *CLASHES])
    assert out.columns == ["doc_id", "leaf", "_g", *CLASHES, "_leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = out.collect()
    assert len(rows) == len(odd_documents())
    assert all(r["verified"] and r["leaf"] == 1 and r["_g"] == 2 and all(r[k] == v for k, v in CLASHES.items()) for r in rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 77])
def test_levels_and_siblings(n):
    leaves = [sha(str(i)) for i in range(n)]
    levels = tree_levels(np.frombuffer("".join(leaves).encode(), np.uint8).reshape(n, 64))
    plain = climb(leaves, 8)
    assert [x.tobytes().decode() for x in levels] == ["".join(x) for x in plain]
    around = siblings(levels)
    for i in range(n):
        at, path = i, []
        for left, right in around:
            path.append((left[at].decode(), right[at].decode()))
            at //= 8
        assert path == path_of(plain, i, 8)
