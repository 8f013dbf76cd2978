import zlib

import pytest

from tallylog.llm.sharding import histogram_sort

from .data import CLASHES, odd_documents, table


def check(rows, shards, most_off):
    sizes, slots = {}, {}
    for r in rows:
        sizes[r["_s"]] = sizes.get(r["_s"], 0) + r["_b"]
        slots.setdefault(r["_s"], []).append(r["_slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean = sum(sizes.values()) / shards
    assert max(abs(sizes.get(s, 0) - mean) for s in range(shards)) <= most_off


def named(df):
    b, c, s, p = df.columns[-4:]
    return [{"_b": r[b], "_crc": r[c], "_s": r[s], "_slot": r[p], "text": r["text"], "doc_id": r["doc_id"]} for r in df.collect()]


def test_odd_documents(spark):
    docs = odd_documents()
    rows = named(histogram_sort(table(spark, docs, clashes=True), shards=4))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted((i is None, i or 0, t or "") for i, t, _, _ in docs)
    for r in rows:
        data = (r["text"] or "").encode()
        assert (r["_b"], r["_crc"]) == (len(data) + 1, zlib.crc32(data))
    check(rows, 4, 60_000)


def test_balance_and_groups(spark):
    docs = [(i, f"text number {i} " * 10, "en", "s") for i in range(3000)] + [(5000 + i, "a copy " * 20, "en", "s") for i in range(1500)]
    rows = named(histogram_sort(table(spark, docs), shards=16))
    check(rows, 16, 0.02 * sum(r["_b"] for r in rows) / 16 + 300)
    homes = {}
    for r in rows:
        homes.setdefault(r["text"], set()).add(r["_s"])
    assert len(homes["a copy " * 20]) > 1  # a third of all bytes must be split
    assert all(len(v) == 1 for k, v in homes.items() if k != "a copy " * 20)


def test_runs_agree_and_columns_stay(spark):
    docs = table(spark, odd_documents(), clashes=True)
    one, two = (sorted(map(str, histogram_sort(docs, shards=5).collect())) for _ in range(2))
    assert one == two
    assert histogram_sort(docs).columns[: len(docs.columns)] == docs.columns
    assert all(r[k] == v for r in histogram_sort(docs).select(*CLASHES).limit(3).collect() for k, v in CLASHES.items())


@pytest.mark.parametrize("rows", [[], [(1, "only", "en", "s")], [(1, None, None, None)] * 3])
def test_tiny(spark, rows):
    out = histogram_sort(table(spark, rows)).collect()
    assert len(out) == len(rows)


def test_many_hot_texts_and_exact_splitters(spark):
    """Splitters and ranges against the sorted keys themselves, with 300 texts of a hundred copies each."""
    from pyspark.sql import functions as F

    from tallylog.llm import sharding

    docs = [(i, f"hot {i % 300}", "en", "s") for i in range(30_000)] + [(40_000 + i, f"single {i} " * 5, "en", "s") for i in range(2000)]
    keyed = table(spark, docs).select(sharding._key(F.col("text"), F.col("doc_id")).alias("_key"), (F.octet_length("text") + 1).cast("long").alias("_size")).persist()
    rows = sorted((r["_key"], r["_size"]) for r in keyed.collect())
    total = sum(b for _, b in rows)
    for shards, tolerance in ((16, 0.01), (3, 0.0001)):
        splitters, ranges = sharding.refine_splitters(keyed, shards, tolerance)
        assert splitters == sorted(splitters) and len(splitters) == shards - 1
        for j, s in enumerate(splitters, 1):
            assert abs(sum(b for k, b in rows if k < s) - total * j / shards) <= max(tolerance * total / shards, 120)
        lows = [low for low, _ in ranges] + [1 << 63]
        assert lows[0] == 0 and sum(n for _, n in ranges) == len(rows)
        at = 0
        for low, high, n in zip(lows[:-1], lows[1:], [n for _, n in ranges], strict=True):
            found = at
            while found < len(rows) and rows[found][0] < high:
                found += 1
            assert found - at == n and low < high
            at = found
        assert set(splitters) <= set(lows)
    out = named(histogram_sort(table(spark, docs), shards=16))
    check(out, 16, 0.02 * total / 16 + 300)
    keyed.unpersist()


def test_one_hot_range_is_cut(spark):
    from pyspark.sql import functions as F

    from tallylog.llm import sharding

    docs = [(i, "one text", "en", "s") for i in range(20_000)] + [(30_000 + i, f"x{i}", "en", "s") for i in range(500)]
    keyed = table(spark, docs).select(sharding._key(F.col("text"), F.col("doc_id")).alias("_key"), F.lit(9).cast("long").alias("_size"))
    _, ranges = sharding.refine_splitters(keyed, 4, 0.01, most_rows=64)
    assert max(n for _, n in ranges) <= 200 and sum(n for _, n in ranges) == 20_500
