"""Documents to packed training sequences: filter, identify, de-duplicate, mix and pack."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from farelens.llm import langid, minhash_join, mixing, packing, weak_quality
from farelens.llm.common import store, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Least share of a text's words that its language has in the documents it was learnt from.
LEAST_KNOWN = 0.2


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return weak_quality.keep_good(docs)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the documents themselves teach.

    A text without a letter goes, and one of whose words too few are known; both go whatever their length.
    """
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")
    judged = langid.with_language(docs.select("text", row), langid.fit(docs))
    sure = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("known") >= LEAST_KNOWN)
    return judged.filter(sure).select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked from a similarity of 0.8."""
    return minhash_join.first_of_each_group(docs, minhash_join.AT_80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(mixing.mix(docs)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("filter_quality", filter_quality),
    ("identify_language", identify_language),
    ("drop_near_duplicates", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

# Rules and languages are learnt by expectation-maximisation and counting, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
