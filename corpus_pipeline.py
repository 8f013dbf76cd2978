"""From raw documents to packed training sequences: language, near-duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again before the next.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.llm import langid, mixing, neardup, packing, pii
from tallylog.llm.common import fresh, stage_table

#: The least probability of a document's language: just above chance, as short clean texts may be unsure ones.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and those in none of the languages learnt from ``docs``' own labels; fills in ``lang`` where there is none."""
    model = langid.fit(docs)
    lang, score = fresh(docs, "lang_pred", "score")
    known = langid.predict(docs, model, lang=lang, score=score).where((F.col(score) >= LEAST_SCORE) & (F.col(lang) != langid.UNKNOWN))
    return known.select(*[F.coalesce("lang", lang).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least id, and one of several rows of that id. Texts that are null or without words are copies of each other only where their ids are equal;
    rows without an id are all kept. Ties can't occur, as ids decide. Very long texts are compared whole, other columns stay, and an empty table stays empty."""
    return neardup.keep_one(docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data under pseudonyms; ``n_chars`` follows the text. A null text stays null (as does its ``n_chars``), an empty one empty; rows with the same text get the same one, long texts are
    read whole, and no row is dropped or added."""
    done = pii.pseudonymise(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in done.columns else done


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none more than three times. Null sources are a source of their own; texts that are null or without words have size 0 and are
    not taken. Repeated rows are documents of their own; documents of one size go in the order of their ids' digests, so that reruns agree. An empty table stays empty."""
    sizes = fresh(docs, "copies")[0]
    return mixing.emit_copies(mixing.systematic_mix(docs), docs.columns, sizes)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens. Copies of a document are told apart by nothing but their place. A null or empty text is one token (the end); texts of more tokens than a sequence has are cut, and
    nothing else is; pieces of equal length go in any order. An empty table gives no rows."""
    return packing.best_fit_pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("private_data", replace_private),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage_table(docs, name)
    return docs
