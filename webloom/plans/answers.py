"""Answers to what is said, from captured pages: over given pages, or over what a lookup of the question visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports, retrieval
from ..sources.tables import kept
from .lookup import lookup


def documents(pages: DataFrame, least: int = 80) -> DataFrame:
    """(doc_id, title, url, text) of the live pages (page_id, url, html) of `least` characters of text."""
    live = reports.live_documents(pages, least)
    return live.join(pages.select("page_id", "url"), "page_id").select(F.col("page_id").alias("doc_id"), "title", "url", "text")


def answers(turns: DataFrame, pages: DataFrame, seed_hosts: list[str] = ()) -> DataFrame:
    """(conv_id, turn, mode, reply) to turns (conv_id, turn, text): from the pages' sentences where any page is live, else small talk."""
    docs = kept(documents(pages))
    return retrieval.small_talk(turns) if docs.isEmpty() else retrieval.sessions(turns, docs, seed_hosts)


def looked_up(spark: SparkSession, question: str, pages: DataFrame, seeds: list[str] = (), **limits) -> DataFrame:
    """(conv_id, turn, mode, reply): one row, the answer from what a lookup of the question visits among captured pages."""
    found = lookup(spark, pages, question, seeds, **limits)
    turn = spark.createDataFrame([(0, 0, question)], "conv_id long, turn long, text string")
    return answers(turn, found.pages)
