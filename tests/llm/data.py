"""Small documents for the operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return; a table may have them, too.
CLASHES = {"size": 1, "shard": 2, "slot": 3, "_key": 4, "copies": 5, "target": 6, "_source": 7, "_size": 8, "class_id": 9, "_keep": 10, "score": 11, "c0": 12, "_pii": 13, "n_words": 14}


def table(spark, rows, clashes=False):
    """rows: (doc_id, text, lang, source)."""
    df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], SCHEMA)
    if clashes:
        from pyspark.sql import functions as F

        df = df.withColumns({k: F.lit(v) for k, v in CLASHES.items()})
    return df


def words(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


def odd_documents(n=60, seed=1):
    """Nulls, empty and long texts, copies, near copies, repeated rows, shared passages."""
    rng = random.Random(seed)
    base, passage = [words(rng, rng.randint(1, 120), 4000) for _ in range(n)], words(rng, 40, 4000)
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(base)]
    rows += [(100 + i, base[7], "en", "s0") for i in range(25)]  # a hot text
    for i in range(12):  # near copies of a longer text
        w = words(random.Random(5), 100, 4000).split()
        w[rng.randrange(100)] = f"x{i}"
        rows.append((200 + i, " ".join(w), "en", "s1"))
    rows += [(300 + i, f"{words(rng, 9, 4000)} {passage} {words(rng, 5, 4000)}", "en", None) for i in range(6)]
    rows += [(400, None, None, None), (401, "", "en", "s2"), (402, " \n\t ", "en", "s2"), (403, words(rng, 9000, 4000), "en", "s3"), (404, "one", "en", "s3"), (404, "one", "en", "s3"), (405, "w" * 30_000, "en", "s3"), (None, "no id here", "en", "s3")]
    return rows
