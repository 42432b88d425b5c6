"""Queries on social profiles: orders point to their customers' profiles, some customers have pages of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles
from ..sources.tables import table
from .table_queries import PROFILES, _put, chosen

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _address(number):
    return _put(chosen(PROFILES, number), "{k}", number)


def _found(spark, d):
    orders = table(spark, d, "orders").filter("o_custkey % 4 < 3")
    return orders.select(_address(F.col("o_custkey")).alias("url"), F.concat(F.lit("order/"), F.col("o_orderkey") % 5).alias("source"), (F.lit(0.35) + (F.col("o_orderkey") % 10) / 20).alias("confidence"))


@query
def profiles_discovered(spark, d):
    return profiles.discovered(_found(spark, d)).select("profile_url", "platform", "username", F.round("confidence", 6).alias("confidence"), F.array_join("sources", ",").alias("sources"))


@query
def profile_trail(spark, d):
    k = F.col("c_custkey")
    pages = table(spark, d, "customer").filter("c_custkey % 4 > 1").select(
        k.alias("page_id"), _address(k).alias("url"), F.when(k % 3 > 0, F.col("c_name")).alias("display"), F.when(k % 5 > 0, F.lower("c_mktsegment")).alias("bio"), F.lit(None).cast("string").alias("avatar")
    )
    return profiles.updated(profiles.discovered(_found(spark, d)), pages).select("profile_url", "platform", "username", F.round("confidence", 6).alias("confidence"), F.array_join("sources", ",").alias("sources"), "display", "bio")


@query
def trail_posts(spark, d):
    """Lines as posts of their order, of which those of one kind of shipping count once."""
    posts = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), F.lit("twitter").alias("platform"), F.concat(F.lit("https://x.com/o"), "l_orderkey").alias("link"), F.concat(F.repeat("l_returnflag", F.lit(80)), "l_linenumber").alias("text")
    )
    return profiles.posts_once(posts).select("seq", "link", F.substring("text", 1, 1).alias("flag"))
