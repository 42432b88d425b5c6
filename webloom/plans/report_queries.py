"""Named queries: reports, policies and names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import reports, topic
from ..sources.tables import table
from .queries import TOPIC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("(null)")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))


@query
def page_upsert_latest(spark, d):
    pages = table(spark, d, "pages").select("url", F.lit(0).alias("seq"), F.length("html").alias("n"))
    again = pages.filter("n % 3 = 0").select("url", F.lit(1).alias("seq"), (F.col("n") + 1).alias("n"))
    return reports.latest(pages.union(again).withColumn("order", F.struct("seq", "n")), ["url"], "order").select("url", "n")


@query
def crawl_stats(spark, d):
    return reports.crawl_stats(table(spark, d, "pages"))


@query
def topic_report_urls(spark, d):
    return reports.by_address(topic.ranked_pages(table(spark, d, "pages"), TOPIC)).select("address", "page_id", "relevance")


@query
def knowledge_subtopics(spark, d):
    return reports.subtopics(table(spark, d, "pages"))


@query
def regional_sources(spark, d):
    pages = table(spark, d, "pages")
    return reports.regional_sources(pages, topic.ranked_pages(pages, TOPIC)).withColumn("rank", F.col("rank").cast("long"))


@query
def theme_counts(spark, d):
    return reports.themes(_documents(spark, d), "source")


@query
def first_person_voice(spark, d):
    return reports.voice(_documents(spark, d), "source")


@query
def live_documents(spark, d):
    return reports.live_documents(table(spark, d, "pages")).select("page_id", "title", F.length("text").cast("long").alias("n_chars"))


@query
def report_slugs(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.path_slug(F.col("text")).alias("slug"))


