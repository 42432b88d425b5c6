"""Work on small rows is dealt over all cores, whatever the bytes of a table; quicker searches find the same."""

import re

from pyspark.sql import functions as F

from webloom.operators import entities, facets
from webloom.plans import evidence_queries, facet_queries, markup_queries


def test_rows_are_dealt_over_all_cores(spark, sf):
    wanted = 3 * spark.sparkContext.defaultParallelism
    for rows in (facet_queries._said(spark, sf), evidence_queries._events(spark, sf), markup_queries.order_pages(spark, sf)):
        assert rows.rdd.getNumPartitions() == wanted


def test_domains_start_at_words(spark):
    texts = ["AI", "said ai_x", "An ML.", "openAI", "smart contracts, Law", "flaw", "éai", "web3", "_law", "AWS-Docker", "xaws", "deep  learning", "LLMs and OSINTx", "", None, "j'ai"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", entities.domains(F.col("text")).alias("d")).collect()
    for r in rows:
        assert list(r.d or []) == ([name for name, p in entities.DOMAINS.items() if re.search(p, r.text, re.A)] if r.text is not None else [])
    assert not entities._starts(entities.DOMAINS.values()).startswith(r"(?i)\b")


def test_own_posts_are_those_without_a_reason(spark):
    pairs = [("Rt @x", None), ("art @x", None), ("we reTweeted", None), ("unretweeted", None), ("REPOSTING", ""), ("shared a post", None), ("Shared  from", None), ("via @", None), ("x", '{"is_retweet" : TRUE}'), ("x", '<a aria-label="My Repost">'), (None, None), ("plain", '{"reposted":false}')]
    for r in spark.createDataFrame(pairs, "t string, h string").select("t", facets.is_own(F.col("t"), F.col("h")).alias("own"), facets.repost_reason(F.col("t"), F.col("h")).alias("why")).collect():
        assert r.own == (r.why is None)


def test_pictures_are_placed_from_kept_pages(spark, sf):
    """Pages are scanned before addresses are reckoned, in a plan of its own."""
    assert "MapInArrow" not in markup_queries.order_images(spark, sf)._jdf.queryExecution().toString()
