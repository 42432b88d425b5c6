"""From a topic to its report in one call, over captured pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import composition, markup, regions, reports, topic
from ..sources.tables import kept
from . import runners


@dataclass
class Lookup:
    """What a lookup came to: the runners' outcome, the captured pages that were visited, what they tell, and the report's lines."""

    outcome: runners.Outcome
    pages: DataFrame
    knowledge: composition.Knowledge
    lines: DataFrame
    topic: str

    def text(self) -> str:
        return composition.markdown(self.topic, self.lines).first()["text"]


def lookup(spark: SparkSession, pages: DataFrame, query: str, seeds: list[str] = (), depth: int = 5, budget: int = 500, least: float = 0.12, batch: int = 12) -> Lookup:
    """The report on a topic from pages (page_id, url, html).

    The crawl begins with seeds, the regions' searches and the `batch` pages whose address says most of the topic, and follows links that are worth it, `depth` deep and within a
    budget of pages. Then a second runner takes, wave by wave, the best addresses of regions that are not told of yet, until it learns nothing new. Only captured pages are read.
    """
    about = topic.Topic.parse(query)
    known = kept(pages.select("page_id", U.normalized(F.col("url")).alias("url"), "html").filter("url is not null"))
    dom = markup.scanned(known)
    links = markup.links(dom).join(known.select("page_id", F.col("url").alias("parent")), "page_id")
    edges = kept(links.filter(topic.follow(F.col("target"), F.col("anchor"), about, 0.1)).select("parent", F.col("target").alias("child"), (topic.link_score(F.col("target"), F.col("anchor"), about) * 100).cast("int").alias("priority")).distinct())
    placed = kept(known.select("url", regions.region(F.col("url"), F.col("html")).alias("region"), topic.url_score(F.col("url"), about).alias("score")).groupBy("url").agg(F.min("region").alias("region"), F.max("score").alias("score")))
    best = placed.orderBy(F.desc("score"), "url").limit(batch).select("url")

    def missing(visited: DataFrame) -> DataFrame:
        told = placed.join(visited.select("url"), "url", "left_semi").select("region").distinct()
        return placed.join(told, "region", "left_anti").join(visited.select("url"), "url", "left_anti").orderBy(F.desc("score"), "url").limit(batch).select("url")

    regional = lambda visited: placed.join(visited.select("url"), "url", "left_semi").select(F.col("region").alias("key"))
    graph = runners.Runner("graph", lambda visited: visited.limit(0).select("url"), lambda visited: visited.select(F.col("url").alias("key")), 1, depth, lambda n: max(budget, n))
    widely = runners.Runner("global", missing, regional, 4, 2, lambda n: min(60, max(4 * n, 8)))
    outcome = runners.run(spark, edges, graph, [widely], runners.initial_seeds(spark, query, list(seeds)).union(best))
    read = kept(known.join(outcome.visited.select("url"), "url", "left_semi"))
    knowledge = composition.gathered(read, query, least)
    lines = composition.lines(knowledge, reports.subtopics(read), links.select("page_id", "target", "pos"), outcome.total_waves, {"graph", "global"} <= outcome.saturated)
    return Lookup(outcome, read, knowledge, lines, query)
