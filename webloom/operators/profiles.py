"""Profiles on social hosts: found in what points to them, told of by their own pages, merged by canonical address; and their posts, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import social

#: Fixed value: how sure a profile is that only its own page tells of.
OWN_PAGE = 0.55


def discovered(found: DataFrame) -> DataFrame:
    """(profile_url, platform, username, confidence, sources) of found (url, source, confidence): a profile once, as sure as its surest source, with all its distinct sources."""
    rows = found.select(social.profile_url(F.col("url")).alias("profile_url"), "source", "confidence").filter("profile_url is not null")
    one = rows.groupBy("profile_url", "source").agg(F.max("confidence").alias("confidence"))
    all_ = one.groupBy("profile_url").agg(F.max("confidence").alias("confidence"), F.sort_array(F.collect_list("source")).alias("sources"))
    told = social.classified(F.col("profile_url"))
    return all_.select("profile_url", told["platform"].alias("platform"), told["username"].alias("username"), "confidence", "sources")


def updated(profiles: DataFrame, pages: DataFrame) -> DataFrame:
    """profiles (of discovered()) with display, bio, avatar and, field by field, what their own pages (page_id, url, display, bio, avatar) tell last.

    A full outer merge by canonical address: a page whose profile was not found adds it, with its own address as the source. A user name that a page has as it is written stands before the canonical one.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("page_id"))).alias(c)
    rows = pages.withColumn("profile_url", social.profile_url(F.col("url"))).withColumn("own_name", social.classified(F.col("url"))["username"]).filter("profile_url is not null")
    own = rows.groupBy("profile_url").agg(last("display"), last("bio"), last("avatar"), last("own_name"), F.min_by("url", "page_id").alias("first_page"))
    both = profiles.join(own, "profile_url", "full")
    return both.select(
        "profile_url", F.coalesce("platform", social.classified(F.col("profile_url"))["platform"]).alias("platform"), F.coalesce("own_name", "username").alias("username"), F.coalesce("confidence", F.lit(OWN_PAGE)).alias("confidence"),
        F.coalesce("sources", F.array("first_page")).alias("sources"), "display", "bio", "avatar",
    )


def posts_once(posts: DataFrame) -> DataFrame:
    """posts (seq, platform, link, text, ...) of which those of one platform, address and beginning (80 characters) count once, the first by seq."""
    keys = ["platform", "link", "start"]
    rest = [c for c in posts.columns if c not in ("platform", "link")]
    rows = posts.withColumn("start", F.substring("text", 1, 80)).groupBy(*keys).agg(F.min_by(F.struct(*rest), "seq").alias("p"))
    return rows.select(*(F.col(c) if c in ("platform", "link") else F.col(f"p.{c}") for c in posts.columns))
