import numpy as np
import pytest
from pyspark.sql import functions as F

from tallylog.llm import chroma


def tune(seed, seconds=12.0, start=0.0):
    rng, rate = np.random.default_rng(seed), chroma.RATE
    notes = rng.integers(0, 24, 400)
    t = np.arange(int(start * rate), int((start + seconds) * rate)) / rate
    return (12000 * np.sin(2 * np.pi * 220 * 2 ** (notes[(t / 0.25).astype(int)] / 12) * t)).astype("<i2")


@pytest.fixture(scope="module")
def found(spark):
    rng = np.random.default_rng(9)
    hop = chroma.HOP / chroma.RATE
    noisy = (tune(1) + rng.normal(0, 600, len(tune(1)))).astype("<i2")
    sounds = {0: tune(1), 1: tune(1), 2: noisy, 3: tune(1, 8.0, 20 * hop), 4: tune(2), 50: tune(3), 5: tune(3), 6: tune(4), 7: np.zeros(60_000, "<i2"), 8: np.zeros(100, "<i2"), 100: tune(1)}
    rows = [(i, s.tobytes()) for i, s in sounds.items()] + [(9, None), (10, b""), (4, tune(2).tobytes())]
    df = spark.createDataFrame(rows, "id long, pcm binary").withColumns({"key": F.lit(1), "prints": F.lit("x"), "offset": F.lit(3)})
    levels = chroma.fit_levels([s.tobytes() for s in sounds.values()])
    return chroma.align(chroma.fingerprints(df, "id", "pcm", levels), F.col("id") % 50 == 0).collect()


def test_every_recording_has_a_row(found):
    assert sorted(r["id"] for r in found) == [0, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10, 50, 100]


def test_copies_noise_and_shifts(found):
    by = {r["id"]: r for r in found}
    assert {by[i]["class_id"] for i in (0, 1, 100)} == {0} and by[50]["class_id"] == by[5]["class_id"] == 5
    assert (by[1]["n_links"], by[1]["best_query_id"], by[1]["bit_error"]) == (2, 0, 0.0)
    assert (by[0]["n_links"], by[0]["best_query_id"]) == (1, 100) and by[100]["best_query_id"] == 0
    assert by[5]["best_query_id"] == 50 and by[5]["n_links"] == 1
    assert by[2]["n_links"] == 2 and by[2]["offset"] == 0 and 0 < by[2]["bit_error"] < 0.25
    # The excerpt begins 20 positions into the tune: its position is the query's less 20.
    assert by[3]["best_query_id"] == 0 and by[3]["offset"] == -20 and by[3]["bit_error"] < 0.05


def test_others_are_left_alone(found):
    by = {r["id"]: r for r in found}
    for i in (4, 6, 7, 8, 9, 10):
        assert by[i]["n_links"] == 0 and by[i]["best_query_id"] is None and by[i]["offset"] is None
    assert by[50]["n_links"] == 0 and by[50]["best_query_id"] is None
    assert [by[i]["n_prints"] for i in (8, 9, 10)] == [0, 0, 0]


def test_nothing(spark):
    empty = spark.createDataFrame([], "id long, pcm binary")
    assert chroma.align(chroma.fingerprints(empty, "id", "pcm", np.zeros((16, 3))), F.lit(True)).collect() == []


def test_integral_image_is_the_sum():
    rng = np.random.default_rng(1)
    image = rng.random((30, 12))
    got = chroma.responses(image)
    assert len(got) == 30 - chroma.WIDEST + 1
    for i, (kind, y, h, w) in enumerate(chroma.FILTERS):
        for t in (0, 7):
            box = image[t : t + w, y : y + h]
            if kind == 0:
                a, b = box.sum(), 0.0
            elif kind == 1:
                a, b = box[:, h // 2 :].sum(), box[:, : h // 2].sum()
            elif kind == 2:
                a, b = box[: w // 2].sum(), box[w // 2 :].sum()
            else:
                continue
            assert got[t, i] == pytest.approx(np.log((1 + a) / (1 + b)))


def test_pitch_classes():
    t = np.arange(3 * chroma.RATE) / chroma.RATE
    for semitone in range(12):
        image = chroma.chroma(8000 * np.sin(2 * np.pi * 440 * 2 ** (semitone / 12) * t))
        assert (image.argmax(axis=1) == semitone).all()


def test_bit_error(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [9, 1, 3, 3], 1)], "a array<int>, b array<int>, o int")
    overlap, error = chroma.bit_error(F.col("a"), F.col("b"), F.col("o"))
    assert tuple(df.select(overlap, error).first()) == (3, 1 / 96)


def test_levels_are_those_of_all_recordings(spark):
    rng = np.random.default_rng(5)
    values = [rng.normal(size=(n, 16)) * 10.0 ** rng.integers(-3, 3, 16) for n in rng.integers(0, 9, 700)] + [np.zeros((40, 16))]
    rows = spark.createDataFrame([(i, (v + 0.0).astype("<f4").tobytes()) for i, v in enumerate(values)], "id long, responses binary").repartition(5)
    want = np.quantile(np.concatenate([v.astype("<f4").astype(float) for v in values]), [0.25, 0.5, 0.75], axis=0).T
    levels = chroma.exact_levels(rows)
    assert np.allclose(levels, want, rtol=1e-12, atol=0)
    got = {r["id"]: r["prints"] for r in chroma.prints_of(rows, levels).collect()}
    assert all(got[i] == chroma.integers(v.astype("<f4").astype(float), levels).tolist() for i, v in enumerate(values))
    assert (chroma.exact_levels(rows.limit(0)) == 0).all()
