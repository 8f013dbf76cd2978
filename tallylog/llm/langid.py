"""Language identification by a byte convolutional network, trained here in numpy.

The network reads fixed-length windows of UTF-8 bytes. For each width it has a bank of filters over one-hot bytes; a filter of width w
is thus w tables of 256 weights, and applying it is w look-ups a position. Each filter is max-pooled over the window, and a
softmax layer turns the pooled values into languages. A text's windows tile all of it; their probabilities are
averaged by the bytes they hold.

The labelled rows to learn from are a bounded sample (``per_language`` documents of each language, chosen by a hash of the id; ``windows``
windows of each at places spread over the whole text). Prediction covers every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, positional, restored
from .shingles import byte_slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Windows that are scored together.
BATCH = 512
UNKNOWN = "und"

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass
class ByteCNN:
    langs: list[str]
    tables: dict[int, np.ndarray] = field(default_factory=dict)  # width -> (width, 256, filters)
    bias: np.ndarray | None = None
    dense: np.ndarray | None = None  # (widths * filters + 1, langs); the last row is the bias

    def _fused(self) -> dict[int, list[np.ndarray]]:
        """Each filter bank as tables over byte pairs, with a table over bytes for an odd width's last one."""
        out = {}
        for w, t in self.tables.items():
            out[w] = [(t[i][:, None, :] + t[i + 1][None, :, :]).reshape(65536, -1) for i in range(0, w - 1, 2)] + ([t[w - 1]] if w % 2 else [])
        return out

    def pooled(self, windows: np.ndarray, fused: dict[int, list[np.ndarray]] | None = None, where: bool = False):
        """Max-pooled filters of uint8 windows (n, WINDOW); with ``where``, also the position of each maximum."""
        fused = fused or self._fused()
        pairs = (windows[:, :-1].astype(np.int32) << 8) + windows[:, 1:]
        values, places = [], []
        for w, parts in fused.items():
            n = windows.shape[1] - w + 1
            acc = None
            for k, table in enumerate(parts):
                at = (windows[:, 2 * k : 2 * k + n] if len(table) == 256 else pairs[:, 2 * k : 2 * k + n])
                got = table.take(at, axis=0)
                acc = got if acc is None else np.add(acc, got, out=acc)
            if where:
                places.append(acc.argmax(axis=1))
            values.append(acc.max(axis=1))
        flat = np.maximum(np.concatenate(values, axis=1) + self.bias, 0)
        return (flat, places) if where else flat

    def probabilities(self, windows: np.ndarray, fused=None) -> np.ndarray:
        z = self.pooled(windows, fused) @ self.dense[:-1] + self.dense[-1]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _windows(data: bytes, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All of ``data`` in windows, the last one padded with spaces, and the bytes that each holds."""
    n = max(1, -(-len(data) // length))
    sizes = np.full(n, length, dtype=np.float32)
    sizes[-1] = max(1, len(data) - (n - 1) * length)
    return np.frombuffer(data.translate(_LOWER).ljust(n * length), dtype=np.uint8).reshape(n, length), sizes


def train(windows: np.ndarray, target: np.ndarray, langs: list[str], epochs: int = 8, filters: int = FILTERS, widths=WIDTHS, seed: int = 7, rate: float = 0.01) -> ByteCNN:
    """Adam on cross-entropy. The gradient of a max-pooled filter touches the bytes under its maximum only."""
    rng = np.random.default_rng(seed)
    model = ByteCNN(langs)
    model.tables = {w: rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths}
    model.bias = np.zeros(filters * len(widths), np.float32)
    model.dense = np.vstack([rng.normal(0, 0.2, (filters * len(widths), len(langs))), np.zeros((1, len(langs)))]).astype(np.float32)
    params = [*model.tables.values(), model.bias, model.dense]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    share = np.bincount(target, minlength=len(langs)).astype(np.float64)
    weight = (len(target) / np.maximum(share, 1) / len(langs)).astype(np.float32)  # languages count alike
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for low in range(0, len(order), 64):
            at = order[low : low + 64]
            x, y = windows[at], target[at]
            # Part of each window is blanked, so that short texts are learnt too.
            x = x.copy()
            keep = rng.choice([16, 48, 128, x.shape[1]], len(x), p=[0.15, 0.2, 0.2, 0.45])
            x[np.arange(x.shape[1])[None, :] >= keep[:, None]] = 32
            h, places = model.pooled(x, where=True)
            z = h @ model.dense[:-1] + model.dense[-1]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= (weight[y] / len(y))[:, None]
            grads = [np.zeros_like(q) for q in params]
            grads[-1][:-1], grads[-1][-1] = h.T @ p, p.sum(axis=0)
            dh = (p @ model.dense[:-1].T) * (h > 0)
            grads[-2] = dh.sum(axis=0)
            for k, (w, place) in enumerate(zip(widths, places, strict=True)):
                d = dh[:, k * filters : (k + 1) * filters]
                for j in range(w):
                    np.add.at(grads[k][j], (x[np.arange(len(x))[:, None], place + j], np.arange(filters)[None, :]), d)
            step += 1
            for i, (q, g) in enumerate(zip(params, grads, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                q -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-7)
    return model


def held_out(ident: Column) -> Column:
    """Whether a document is kept from learning: CRC-32 of its id as text, mod 3, is 1. A null id counts as empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample_windows(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, windows: int) -> list:
    """Rows (lang, list of byte windows) of a bounded sample of the labelled rows that aren't held out."""
    rows = df.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = rows.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    luck = F.abs(F.xxhash64(F.col(id_col), F.lit("langid"))) / F.lit(float(1 << 63))
    share = df.sparkSession.createDataFrame([(r[0], min(1.0, per_language / r["n"])) for r in counts], "_lang string, _share double")
    data = F.col(text_col).cast("binary")
    size = F.octet_length(data)
    # Spread over the whole text; in bytes, so that a window may begin inside a character, as it may in prediction.
    starts = [F.greatest(F.lit(1), (size - WINDOW) * F.lit(k / max(1, windows - 1)) + 1).cast("int") for k in range(windows)]
    cuts = F.when(size <= WINDOW, F.array(data)).otherwise(F.array(*[F.substring(data, s, F.lit(WINDOW)) for s in starts]))
    chosen = rows.select(F.col(lang_col).cast("string").alias("_lang"), luck.alias("_luck"), cuts.alias("cuts")).join(F.broadcast(share), "_lang").where("_luck < _share")
    return chosen.select(F.col("_lang").alias("lang"), "cuts").limit(2 * per_language * max(1, len(counts))).collect()


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 800, windows: int = 3) -> ByteCNN:
    """A model of the languages among the labelled rows that aren't held out; with none, one that knows no language."""
    rows = sample_windows(df, id_col, text_col, lang_col, per_language, windows)
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return ByteCNN([])
    pairs = sorted((langs.index(r["lang"]), bytes(c)) for r in rows for c in r["cuts"])
    return train(np.concatenate([_windows(c)[0][:1] for _, c in pairs]), np.array([k for k, _ in pairs]), langs)


def predict(df: DataFrame, model: ByteCNN, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with two more columns: the language found and its probability.

    A text that is null or has no letter is ``und`` with score 0, as is every text where the model knows no language. One language known: always that one.
    ``df``'s own columns stay, also such as have other columns' internal names; give ``lang`` and ``score`` names that are free.
    """

    @F.arrow_udf("lang string, score double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fused = model._fused()
        for texts in batches:
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            held: list[np.ndarray] = []
            sizes: list[np.ndarray] = []
            owners: list[np.ndarray] = []
            sums, n = np.zeros((len(texts), max(1, len(model.langs)))), 0

            def flush() -> None:
                x, s, o = np.concatenate(held), np.concatenate(sizes), np.concatenate(owners)
                for low in range(0, len(x), BATCH):
                    p = model.probabilities(x[low : low + BATCH], fused)
                    np.add.at(sums, o[low : low + BATCH], p * s[low : low + BATCH, None])
                held.clear(), sizes.clear(), owners.clear()

            for i, data in ((i, t) for low, _, some in byte_slices(texts) for i, t in enumerate(some, low)):
                if not model.langs or not any(map(str.isalpha, data.decode("utf-8", "replace"))):
                    continue
                x, s = _windows(data)
                held.append(x), sizes.append(s), owners.append(np.full(len(s), i))
                n += len(s)
                if n >= 4 * BATCH:
                    flush()
                    n = 0
            if held:
                flush()
            total = sums.sum(axis=1)
            for i in np.flatnonzero(total):
                k = int(sums[i].argmax())
                langs[i], scores[i] = model.langs[k], min(1.0, sums[i, k] / total[i])
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])
            del texts
            give_back()

    own = df.columns
    df, text_col = positional(df, text_col)
    # A filter on the result would otherwise evaluate the network once more.
    out = df.withColumn("_langid", scored.asNondeterministic()(F.col(text_col)))
    return out.select(*restored(out, own), F.col("_langid.lang").alias(lang), F.col("_langid.score").alias(score))


def op2_byte_cnn(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from two thirds of the labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
