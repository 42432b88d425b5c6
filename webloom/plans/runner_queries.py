"""Queries on runners over the links of captured pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..sources.tables import kept, table
from . import runners
from .queries import _links

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _outcome(spark, d):
    """A first crawl from every fifth page; then three runners from the pages of the other fifths, the least addresses first, some in a wave."""
    pages = kept(table(spark, d, "pages").select("page_id", U.normalized(F.col("url")).alias("url")))
    edges = kept(_links(table(spark, d, "pages")).join(pages, "page_id").select(F.col("url").alias("parent"), F.col("target").alias("child"), F.lit(50).alias("priority")).distinct())

    def of(k: int, most: int):
        own = pages.groupBy("url").agg(F.min("page_id").alias("page_id")).filter(F.col("page_id") % 5 == k).select("url")
        return lambda visited: own.join(visited.select("url"), "url", "left_anti").orderBy("url").limit(most)

    known = lambda visited: visited.select(F.col("url").alias("key"))
    fixed = lambda visited: visited.limit(0).select(F.col("url").alias("key"))
    first = runners.Runner("graph", of(0, 1), known, depth=2, budget=lambda n: 1_000_000)
    others = [runners.Runner("wide", of(1, 3), known, 4, 1, lambda n: 1_000_000), runners.Runner("still", of(2, 2), fixed, 5, 0, lambda n: 1_000_000), runners.Runner("all", of(3, 1_000_000), known, 3, 1, lambda n: 1_000_000)]
    initial = pages.groupBy("url").agg(F.min("page_id").alias("page_id")).filter("page_id % 5 = 0").select("url")
    return runners.run(spark, edges, first, others, initial)


@query
def runner_waves(spark, d):
    return runners.waves(_outcome(spark, d)).select("runner", F.col("wave").cast("long").alias("wave"), F.col("round").cast("long").alias("round"), "n_pages")
