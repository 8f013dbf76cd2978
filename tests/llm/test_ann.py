import numpy as np
import pytest
from pyspark.sql import functions as F

from tallylog.llm import ann


def brute(rows, k=10, every=10):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=np.float64)
    lengths = [len(v) for v in good.values()]
    dim = min(set(lengths), key=lambda n: (-lengths.count(n), n)) if lengths else 0
    good = {i: v for i, v in good.items() if len(v) == dim}
    out = {}
    for q in [i for i in good if i % every == 0]:
        near = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q)[:k]
        out[q] = near
    return out


def run(spark, rows, every=10, kind="float", **how):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"id": F.lit(1), "rank": F.lit(2), "vec": F.lit("x"), "score": F.lit(0.5)})
    got = {}
    for r in ann.anisotropic_search(df, F.col("vec_id") % every == 0, **how).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for found in got.values():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, len(found) + 1))
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
    return got


def vectors(n, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, dim))
    return [(i, (v / np.linalg.norm(v)).astype(np.float32).tolist()) for i, v in enumerate(x)]


def test_recall(spark):
    rows = vectors(4000)
    got, want = run(spark, rows), brute(rows)
    assert set(got) == set(want)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    exact = {(q, i): s for q in want for s, i in want[q]}
    assert all(s == pytest.approx(exact[q, i], rel=1e-12) for q in got for _, i, s in got[q] if (q, i) in exact)


def test_odd_vectors_and_ties(spark):
    rows = vectors(150, 7) + [(200 + i, [0.5] * 7) for i in range(300)]
    rows += [(1000, None), (1010, [0.0] * 7), (1020, [1.0, None] + [0.0] * 5), (1030, [float("nan")] * 7), (1040, [float("inf")] + [0.0] * 6), (1050, [1.0, 2.0]), (1060, []), (None, [0.5] * 7), (210, [0.5] * 7)]
    got, want = run(spark, rows, kind="double"), brute(rows)
    assert {q: [i for _, i, _ in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_few(spark):
    assert run(spark, []) == {} and run(spark, [(10, [1.0])]) == {}
    assert {q: [i for _, i, _ in v] for q, v in run(spark, [(10, [1.0, 0.0]), (3, [0.9, 0.1]), (20, [0.0, 1.0])]).items()} == {10: [3, 20], 20: [3, 10]}


def test_query_blocks_agree(spark, monkeypatch):
    rows = vectors(600)
    one = run(spark, rows)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    assert run(spark, rows) == one


def test_codes_prefer_the_parallel_part():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def parallel_error(codec):
        s = codec.split(x)
        back = codec.centroids[np.arange(codec.parts)[None, :], codec.encode(s)].reshape(len(x), -1)
        return np.abs(((x - back) * x).sum(axis=1)).mean()

    plain = ann.AnisotropicCodec(16)
    plain.eta, weighted = 1.0, ann.AnisotropicCodec(16)
    weighted.eta = 6.0
    assert parallel_error(weighted.fit(x)) < 0.8 * parallel_error(plain.fit(x))


def test_tables_are_the_codes_inner_products():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(50, 9)), rng.normal(size=(4, 9))
    codec = ann.AnisotropicCodec(9).fit(x)
    codes = codec.encode(codec.split(x))
    packed, tables = codec.packed(codes), codec.tables(q)
    scanned = np.stack([sum(tables[i, p][packed[p]] for p in range(len(packed))) for i in range(4)])
    back = codec.centroids[np.arange(codec.parts)[None, :], codes].reshape(50, -1)[:, :9]
    assert np.allclose(scanned, q @ back.T, atol=1e-4)


@pytest.mark.parametrize("times", [2, 11, 120])
def test_repeated_rows_take_no_neighbours_place(spark, times):
    rows = vectors(60, 6) + [(100 + i, [0.5] * 6) for i in range(30)]
    again = [r for r in rows for _ in range(times if r[0] < 8 or r[0] in (100, 101) else 2)]
    want = {q: [i for _, i in v] for q, v in brute(rows).items()}
    assert {q: [i for _, i, _ in v] for q, v in run(spark, spread(again), kind="double").items()} == want


def spread(rows):
    """Copies in the same batches and in different ones."""
    return rows[::2] + rows[1::2]


def test_ids_with_many_vectors_count_once(spark):
    rows = [(10, [1.0, 0.0])] + [(1, [1.0, 0.001 * i]) for i in range(1, 301)] + [(i, [1.0, 1.0 + i]) for i in range(2, 9)]
    assert [i for _, i, _ in run(spark, rows, kind="double")[10]] == [1, 2, 3, 4, 5, 6, 7, 8]


def test_blocks_are_written_one_at_a_time(spark, monkeypatch):
    seen = []
    frame, stage = type(spark.range(1)), ann.stage_table
    to_pandas = frame.toPandas
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    monkeypatch.setattr(frame, "toPandas", lambda df: seen.append("queries") or to_pandas(df))
    monkeypatch.setattr(ann, "stage_table", lambda df, name: seen.append(name) or stage(df, name))
    run(spark, vectors(600))
    assert seen[1:] == ["vectors", "queries", "queries", "found0", "queries", "found1", "queries", "found2"]


def odd_tables():
    rng = np.random.default_rng(4)
    centres = 3 * rng.normal(size=(5, 16))
    some = centres[rng.integers(0, 5, 3000)]
    yield "tight groups", some + 1e-4 * rng.normal(size=some.shape)
    yield "far from zero", 1000 + rng.normal(size=(3000, 16))
    yield "no structure", rng.normal(size=(3000, 16))
    yield "odd lengths", rng.normal(size=(3000, 16)) * np.exp(3 * rng.normal(size=(3000, 1)))
    yield "unequal components", rng.normal(size=(3000, 16)) * 10.0 ** -np.arange(16)
    yield "one far away", np.concatenate([rng.normal(size=(2999, 16)), np.full((1, 16), 1e9)])


@pytest.mark.parametrize(("name", "x"), list(odd_tables()), ids=lambda v: v if isinstance(v, str) else "")
def test_no_neighbour_is_missed_on_odd_tables(spark, name, x):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute(rows, every=100)
    assert {q: [i for _, i, _ in v] for q, v in run(spark, rows, 100, "double").items()} == {q: [i for _, i in v] for q, v in want.items()}
