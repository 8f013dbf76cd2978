import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallylog.llm import langid

from .data import CLASHES, table

SYLLABLES = {"xa": ["the", "tion", "ing", "er", "wh"], "xb": ["sch", "ung", "eit", "ver", "ß"], "xc": ["eau", "eux", "ç", "tre", "é"]}


def documents(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 200))), lang, "s"))
    return out


def test_held_out_accuracy(spark):
    docs = table(spark, documents(400))
    out = langid.predict(docs, langid.fit(docs)).withColumn("held", langid.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r["held"]]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert len(held) > 80 and np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_held_out_labels_are_not_read(spark):
    docs = documents(300)
    wrong = [(i, t, "liar" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s) for i, t, lang, s in docs]
    assert langid.fit(table(spark, wrong)).langs == sorted(SYLLABLES)


def test_odd_texts(spark):
    docs = table(spark, documents(200) + [(1000, None, None, None), (1001, "", "xa", "s"), (1002, "123 !?", "xa", "s"), (1003, "thetioner " * 20_000, None, None), (1004, "x", None, None), (None, "eaueux tre eau", "xc", "s")], clashes=True)
    out = langid.predict(docs, langid.fit(docs), score="how_sure")
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]["how_sure"] == 0
    assert got[1003]["lang_pred"] == "xa" and got[None]["lang_pred"] == "xc" and got[1004]["lang_pred"] in SYLLABLES
    assert all(got[0][k] == v for k, v in CLASHES.items())


def test_nothing_to_learn(spark):
    docs = table(spark, [(1, "some text", None, None)])
    assert [r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()] == ["und"]
    empty = table(spark, [])
    assert langid.predict(empty, langid.fit(empty)).collect() == []


def test_fused_tables_are_the_filters():
    rng = np.random.default_rng(1)
    model = langid.train(rng.integers(32, 120, (40, langid.WINDOW)).astype(np.uint8), rng.integers(0, 2, 40), ["a", "b"], epochs=1)
    x = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    direct = []
    for w, t in model.tables.items():
        n = x.shape[1] - w + 1
        direct.append(sum(t[j][x[:, j : j + n]] for j in range(w)).max(axis=1))
    assert np.allclose(model.pooled(x), np.maximum(np.concatenate(direct, axis=1) + model.bias, 0), atol=1e-5)


def test_windows_cover_all_bytes():
    data = bytes(range(97, 123)) * 50
    windows, sizes = langid._windows(data)
    assert windows.tobytes().rstrip(b" ") == data and sizes.sum() == len(data)
