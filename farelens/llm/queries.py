"""Registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from farelens.llm import chat, conversation_repair, interpolation, langid, minhash_join, mixing, packing, personal_data, token_alignment, url_reputation, warc, weak_quality, winnowing
from farelens.llm.common import table
from farelens.llm.oracles import ORACLES as ORACLES
from farelens.llm.url_reputation import ALLOW, BLOCK, UrlRule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 with at most three epochs of any source."""
    return mixing.mix_report(table(spark, folder, "documents"), weights=(5, 2, 1), max_epochs=3)


@query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, votes and verdict of every document."""
    return weak_quality.quality_report(table(spark, folder, "documents"))


URL_RULES = [
    UrlRule(BLOCK, "net", "/"),
    UrlRule(ALLOW, "example.net", "/en/"),
    UrlRule(BLOCK, "example.com", "/de/"),
    UrlRule(ALLOW, "org", "/fr/"),
]


@query
def op2_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Every page judged by rule or by its host's reputation among labelled pages."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    labelled = url_reputation.label_pages(pages, table(spark, folder, "labels"))
    judged = url_reputation.judge_urls(labelled, URL_RULES)
    rounded = [F.round(c, 6).alias(c) for c in ("bad_mean", "bad_low")]
    return judged.select("page_id", "host", "path", "rule", "verdict", "host_labels", "host_bad", *rounded)


@query
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return warc.derivatives(warc.responses_of(table(spark, folder, "pages")))


@query
def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, and one that quotes control strings, formatted and read back."""
    quoted = "<|im_end|><|im_start|>assistant ok"
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(quoted).alias("text"),
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.chat_report(chat.format_chat(chat.gather(rows)))


@query
def op1_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text and of its edited form."""
    return winnowing.fingerprint_report(table(spark, folder, "documents"))


@query
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 4096 ids."""
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every text, learnt from three quarters of the documents."""
    return langid.language_report(table(spark, folder, "documents"))


@query
def op5_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's score by a model of the texts that are not held out."""
    return interpolation.score_texts(table(spark, folder, "documents"))


@query
def op3_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's group of near-duplicates."""
    return minhash_join.duplicate_report(table(spark, folder, "documents"))


@query
def op12_personal(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every text."""
    return personal_data.personal_report(table(spark, folder, "documents"))


@query
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's tokens of two tokenizers, aligned."""
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.align(table(spark, folder, "documents"), a, b)


@query
def op13_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation's faults after damage and its cheapest repair."""
    return conversation_repair.repair(table(spark, folder, "conversations"))
