"""The frontier of a crawl over captured pages, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enqueued(frontier: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new without what the frontier has and without repeats: the first by seq stays. Nulls are equal to each other."""
    w = Window.partitionBy(*keys).orderBy("seq")
    first = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    on = [F.col(f"f.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = on[0]
    for x in on[1:]:
        both = both & x
    return first.alias("n").join(frontier.alias("f"), both, "left_anti")


def popped(frontier: DataFrame, k: int, by: list[str] = ()) -> DataFrame:
    """The next k of the frontier (of each group by): highest priority, then lowest depth, then first come."""
    order = [F.desc("priority"), F.asc("depth"), F.asc("seq")]
    if not by:
        return frontier.orderBy(*order).limit(k)
    return frontier.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def capped(children: DataFrame, k: int) -> DataFrame:
    """children (page_id, url, priority, pos): each url of a page once, with its highest priority, and the k best."""
    once = children.groupBy("page_id", "url").agg(F.max("priority").alias("priority"), F.min("pos").alias("pos"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("priority"), "pos"))).filter(F.col("rank") <= k)


def fingerprints(keys: DataFrame, by: list[str], key: str = "key") -> DataFrame:
    """(by..., n_keys, fingerprint): equal for groups with equal sets of keys, regardless of order, repeats, case and blanks around them; empty keys don't count.

    Sums and exclusive ors of two hashes of each distinct key: they combine on the map side, and no group is ever one list.
    """
    told = keys.select(*by, F.lower(F.trim(key)).alias("k")).filter("k <> ''").distinct().withColumn("h", F.md5("k"))
    half = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("long")
    sums = told.groupBy(*by).agg(F.count(F.lit(1)).alias("n_keys"), F.bit_xor(half(1)).alias("x"), F.sum(half(1).cast("decimal(38,0)")).alias("s"), F.bit_xor(half(17)).alias("y"), F.sum(half(17).cast("decimal(38,0)")).alias("t"))
    return sums.select(*by, "n_keys", F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in ("n_keys", "x", "s", "y", "t"))), 256).alias("fingerprint"))


#: The engines that pages are fetched by.
ENGINES = ("http", "playwright", "archive")


def engine(explicit: Column, source: Column, js_heavy: Column, default: str = "http") -> Column:
    """The engine asked for, http for one that isn't there; where none is asked for, by source and scripts."""
    asked = F.when(explicit.isin(*ENGINES), explicit).when(explicit != "auto", default)
    return F.coalesce(asked, F.when(source.isin("wayback", "common_crawl"), "archive").when(js_heavy, "playwright").otherwise(default))
