"""Queries of the training-data operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, decontam, exact, katz, langid, packing, pii, simhash, tokens, toxicity
from quarry.llm.common import table

#: A real run takes its key from a secret store; equal keys give equal pseudonyms.
PII_KEY = b"example key of the registered query"

#: Where the public vocabularies lie on the driver; Spark carries the one that is used to the executors.
VOCABULARY = os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(table(spark, sf_dir, "documents"), PII_KEY)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents are the history, the others the new arrivals."""
    return exact.keepers(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of kind ids, one for each document, and of kind rank, the table that decodes them."""
    encoded, ranks = tokens.binary_ids(table(spark, sf_dir, "documents"), VOCABULARY)
    return encoded.withColumn("kind", F.lit("ids")).unionByName(ranks.withColumn("kind", F.lit("rank")), allowMissingColumns=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_katz, op2_pii, op3_exact_dedup, op4_token_ids, op5_toxicity, op6_decontamination, op7_near_dedup, op8_language_id, op9_chat, op10_packing)
}
SQL: dict[str, str] = {"op3_exact_dedup": exact.SQL, "op9_chat": chat.SQL}
