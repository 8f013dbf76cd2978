import re
from pathlib import Path

import pyarrow as pa

import corpus_pipeline
from tallylog.llm import langid

from .data import CLASHES, odd_documents, table
from .test_langid import documents


def run(spark, docs):
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, None).cache()
        sizes.append((name, new.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert new.columns == docs.columns, name
        docs = new
    return docs, dict(sizes)


def test_stages(spark):
    base = [(1000 + i, t, lang, s) for i, t, lang, s in documents(120)]
    docs = base + [(5000, base[5][1], "xa", "s"), (5001, base[5][1] + " ", "xa", "s"), (5002, "mail me at a.b@c.example " + base[9][1], "xa", "t"), (5003, None, None, None), (5004, "123 456", "xa", "s")]
    packed, sizes = run(spark, table(spark, docs, clashes=True))
    assert sizes["language"] == len(docs) - 2
    assert sizes["near_duplicates"] <= sizes["language"] - 2 and sizes["near_duplicates"] == sizes["private_data"]
    assert sizes["mixing"] > 0
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_private_data_goes(spark):
    docs = table(spark, [(1, "mail me at a.b@c.example now", "en", "s"), (2, "clean", "en", "s")], clashes=True)
    rows = {r["doc_id"]: r for r in corpus_pipeline.replace_private(spark, docs, None).collect()}
    assert "a.b@c" not in rows[1]["text"] and rows[1]["n_chars"] == len(rows[1]["text"]) and rows[2]["text"] == "clean"
    assert all(r[k] == v for r in rows.values() for k, v in CLASHES.items())


def test_odd_documents_and_none(spark):
    run(spark, table(spark, odd_documents(), clashes=True))
    _, sizes = run(spark, table(spark, []))
    assert set(sizes.values()) == {0}


def test_stage_methods():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "private_data", "mixing", "packing"]
    assert corpus_pipeline.langid is langid


def test_batches_that_are_done_go_back_to_the_machine():
    """Arrow's pool would keep them in a worker that other stages use later, beside its executor."""
    from tallylog.llm.common import give_back

    held = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10
    give_back()
    before = held()
    batches = [pa.array(["x" * 2000] * 5000) for _ in range(8)]
    assert held() > before + 60
    del batches
    give_back()
    assert held() < before + 30
