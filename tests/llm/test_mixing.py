import re

import pytest
from pyspark.sql import functions as F

from tallylog.llm import mixing
from tallylog.llm.mixing import emit_copies, systematic_mix

from .data import odd_documents, table


def targets(sizes):
    """Water filling, one source after the other."""
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[k] for k in full)
        weights = sum(weight[k] for k in names if k not in full)
        share = rest / weights if weights else 0
        new = {k for k in names if k not in full and 3 * sizes[k] <= share * weight[k]}
        if not new:
            return {k: 3 * sizes[k] if k in full else share * weight[k] for k in names}
        full |= new


def test_against_brute_force(spark):
    docs = odd_documents(n=300)
    out = systematic_mix(table(spark, docs, clashes=True))
    size, source_size, target, copies = out.columns[-4:]
    rows = out.collect()
    assert len(rows) == len(docs)
    sizes = {}
    for _, t, _, s in docs:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = targets(sizes), {}
    for r in rows:
        assert r[size] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r[source_size] == sizes[r["source"]] and r[target] == pytest.approx(want[r["source"]])
        assert 0 <= r[copies] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r[size] * r[copies]
    for s, t in want.items():
        biggest = max(len((x or "").split()) for _, x, _, k in docs if k == s)
        assert abs(taken[s] - t) <= biggest


def test_reruns_agree_whatever_the_partitions(spark):
    docs = table(spark, odd_documents())
    a, b = systematic_mix(docs), systematic_mix(docs.repartition(7))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_small_sources_end_near_their_targets(spark):
    """Within the words of a short document or a hundredth, though their longest documents are half of all they have."""
    docs = [(100 * s + i, "w " * (2000 if i < 2 else 5 + 7 * i), "en", f"s{s}") for s in range(9) for i in range(40)]
    rows = systematic_mix(table(spark, docs), carry=False).collect()
    taken, target = {}, {}
    for r in rows:
        taken[r["doc_id"] // 100] = taken.get(r["doc_id"] // 100, 0) + r["size"] * r["copies"]
        target[r["doc_id"] // 100] = r["target"]
    assert all(abs(taken[s] - target[s]) <= max(20, 0.01 * target[s]) for s in target)


def test_without_carrying_the_same(spark):
    docs = table(spark, odd_documents())
    whole, narrow = systematic_mix(docs), systematic_mix(docs, carry=False)
    assert narrow.columns == ["doc_id", "size", "source_size", "target", "copies"]
    assert sorted(map(str, whole.select(*narrow.columns).collect())) == sorted(map(str, narrow.collect()))


def test_emitted(spark):
    docs = table(spark, odd_documents())
    mixed = systematic_mix(docs)
    emitted = emit_copies(mixed, docs.columns)
    assert emitted.columns == docs.columns
    assert emitted.count() == mixed.agg(F.sum("copies")).first()[0]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "", "en", "a"), (2, "", "en", "b")]])
def test_no_words(spark, rows):
    out = systematic_mix(table(spark, rows)).collect()
    assert len(out) == len(rows) and all(r["target"] == 0 and r["copies"] == 0 for r in out)


def test_one_source_is_taken_once(spark):
    out = systematic_mix(table(spark, [(i, "a b c", "en", "x") for i in range(20)])).collect()
    assert [r["copies"] for r in out] == [1] * 20


def test_order_does_not_hang_on_the_number_of_rows(spark, monkeypatch):
    docs = table(spark, odd_documents(n=300) + [(10_000 + i, "a b c", "en", "hot") for i in range(100)])
    got = sorted(map(str, systematic_mix(docs).collect()))
    for salts in (1 << 14,):
        monkeypatch.setattr(mixing, "salts_for", lambda rows, salts=salts: salts)
        assert sorted(map(str, systematic_mix(docs).collect())) == got
