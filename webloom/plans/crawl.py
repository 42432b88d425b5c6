"""A crawl over captured pages, wave by wave, and when it has seen all it will see."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import kept


@dataclass(frozen=True)
class CrawlSpec:
    max_depth: int = 3
    max_pages: int = 1000
    batch: int = 1_000_000
    max_waves: int = 10_000


def crawl(spark: SparkSession, seeds: DataFrame, edges: DataFrame, spec: CrawlSpec = CrawlSpec()) -> DataFrame:
    """(url, depth, priority, wave) of what a crawl visits.

    seeds: url, priority; edges: parent, child, priority (higher first). Each wave takes the best `batch` of the frontier,
    as far as the page budget goes, drops what is visited, and adds its children one deeper. A url that waits and is reached by several
    ways has the highest of their priorities and the least of their depths. It ends when nothing waits or the budget is spent,
    and raises an error where that takes more than max_waves.
    """
    once = lambda rows: kept(rows.groupBy("url").agg(F.min("depth").alias("depth"), F.max("priority").alias("priority")))
    frontier = once(seeds.select("url", F.lit(0).alias("depth"), "priority"))
    visited, taken = None, 0
    for wave in range(spec.max_waves):
        room = spec.max_pages - taken
        if room <= 0:
            break
        n, most = frontier.count(), min(room, spec.batch)
        if not n:
            break
        # the whole frontier, where it fits, needs no order
        batch = frontier if n <= most else kept(frontier.orderBy(F.desc("priority"), "depth", "url").limit(most))
        n = min(n, most)
        taken += n
        done = batch.select("url", "depth", "priority", F.lit(wave).alias("wave"))
        visited = done if visited is None else visited.union(done)
        children = batch.filter(F.col("depth") < spec.max_depth).join(edges.withColumnRenamed("priority", "p"), F.col("url") == F.col("parent"))
        children = children.select(F.col("child").alias("url"), (F.col("depth") + 1).alias("depth"), (F.col("p") - F.col("depth") - 1).alias("priority"))
        both = frontier.union(children).join(visited.select("url"), "url", "left_anti")
        frontier = once(both)
    else:
        raise RuntimeError(f"the crawl has not ended after {spec.max_waves} waves")
    if visited is None:
        return frontier.withColumn("wave", F.lit(0)).limit(0)
    return visited


def saturation(waves: DataFrame) -> DataFrame:
    """(wave, fingerprint, saturated) from keys seen by wave (wave, key): whether the set so far is that of the wave before."""
    first = waves.groupBy(F.lower(F.trim("key")).alias("key")).agg(F.min("wave").alias("wave"))
    new = first.groupBy("wave").count()
    every = waves.select("wave").distinct()
    return every.join(new, "wave", "left").select("wave", F.coalesce("count", F.lit(0)).alias("n_new"), F.col("count").isNull().alias("saturated"))
