"""A corpus pipeline over documents: language, near duplicates, secrets, mixture, packing.

Each stage is given all rows that its predecessor kept, written as Parquet and read again, and returns the columns of
documents; the last returns packed pieces. What a stage has read is deleted once the next has written.

A null text, or one without a letter, has no language and goes in the first stage, and so do empty texts; a null lang is filled in with the prediction. Rows with
null or repeated ids stay as they are, and of repeated texts one stays, by the second stage. Very long texts are kept whole. Ties: near duplicates keep the least
id of a class; equal ids of equal texts the first row. A null source is a source of its own in the mixture. An empty table gives no pieces. Columns beside those of documents pass through all but the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from webloom.llm import credentials, language, mixing, near, packing
from webloom.llm.shared import discard, id_remainder, read, stored


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the mixture model tells; those that are null or have no letter go."""
    return language.identified(docs, language.fit(docs.filter(id_remainder("doc_id", 5) != 0).select("lang", "text")))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near.representatives(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts replaced by a mark."""
    return credentials.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics are a little more even."""
    return mixing.sample(docs, power=dict.fromkeys(mixing.SIDES, 0.95), share=0.9)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language_stage), ("near duplicates", duplicate_stage), ("secrets", secret_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Signatures, subword ids and fitted models aren't expressible in SQL; tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    *filters, last = STAGES
    for name, stage in filters:
        kept = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discard(docs)
        docs = kept
    return last[1](spark, docs, sf_dir)
