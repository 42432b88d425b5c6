"""Queries on what pages tell, on seeds and on captures; each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import entities, intel, topic
from ..sources import archive
from ..sources.tables import table
from .queries import TOPIC, _captures, _links, _texts

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def captured_originals(spark, d):
    return archive.originals(_captures(spark, d), "u1%", 30)


@query
def captured_pairs(spark, d):
    return archive.pairs(_captures(spark, d), "u1%", 20).select("url", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query
def historical_snapshots(spark, d):
    rows = archive.daily(_captures(spark, d)).orderBy("ts", "url").limit(30)
    return rows.select("url", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query
def seed_hosts(spark, d):
    return table(spark, d, "pages").select(U.bare_host(F.col("url")).alias("host")).filter("host <> ''").distinct()


@query
def frontier_seeds(spark, d):
    pages = table(spark, d, "pages").select("page_id", U.normalized(F.col("url")).alias("url"))
    found = _links(table(spark, d, "pages")).select(F.col("target").alias("url"))
    return intel.seeded(pages.filter("page_id % 3 = 0"), found, pages)


@query
def pages_accepted(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html", F.when(F.col("page_id") % 5 == 0, 404).otherwise(200).alias("status"), F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit("<!-- rendered -->"))).alias("rendered"))
    return intel.accepted(pages).select("page_id", F.length("body").alias("n_chars"))


@query
def plain_children(spark, d):
    rows = _links(table(spark, d, "pages")).filter("pos < 200").groupBy("page_id", F.col("target").alias("url")).agg(F.min("pos").cast("long").alias("pos"))
    return rows.withColumn("priority", (50 - F.col("page_id") % 3).cast("int"))


@query
def seed_bundle(spark, d):
    pages = table(spark, d, "pages")
    return intel.bundle(_links(pages).select(F.col("target").alias("url")), pages.filter("page_id % 2 = 0").select(U.normalized(F.col("url")).alias("url")))


@query
def same_host_links(spark, d):
    rows = _links(table(spark, d, "pages")).join(table(spark, d, "pages").select("page_id", "url"), "page_id")
    return rows.groupBy("page_id").agg(F.count_if(U.same_host(F.col("url"), F.col("target"))).alias("n_same"))


@query
def seed_host_pages(spark, d):
    return table(spark, d, "pages").select("page_id", U.within(U.host(F.col("url")), ["example.com", "example.org"]).alias("seeded"))


@query
def jobs_by_time(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select(F.col("o_orderkey").alias("job"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"))


@query
def wave_totals(spark, d):
    seen = table(spark, d, "events").select(F.floor(F.col("event_id") / 1000).alias("wave"), "user_id")
    first = seen.groupBy("user_id").agg(F.min("wave").alias("wave"))
    waves = seen.groupBy("wave").agg(F.count(F.lit(1)).alias("n_rows")).join(first.groupBy("wave").agg(F.count(F.lit(1)).alias("n_new")), "wave", "left")
    return waves.agg(F.count(F.lit(1)).alias("n_waves"), F.sum("n_rows").alias("n_rows"), F.sum("n_new").alias("n_keys"), F.bool_and(F.when(F.col("wave") > 0, F.col("n_new").isNull())).alias("all_saturated"))  # all waves but the first


@query
def page_intel(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", T.title(html).alias("title"), intel.description(html).alias("description"), F.array_join(intel.headings(html), "|").alias("headings"), F.size(entities.emails(html)).cast("long").alias("n_emails"))


@query
def page_claims(spark, d):
    rows = table(spark, d, "pages").withColumn("title", T.title(F.col("html")))
    return rows.select("page_id", F.explode(intel.claims(F.col("html"), F.col("title"))).alias("claim"))


@query
def topic_snippets(spark, d):
    rows = _texts(table(spark, d, "documents"))
    return rows.select("doc_id", F.posexplode(intel.snippets(F.col("text"), TOPIC)).alias("pos", "snippet")).select("doc_id", F.col("pos").cast("long").alias("pos"), "snippet")


@query
def source_links(spark, d):
    return topic.ranked_pages(table(spark, d, "pages"), TOPIC).select("page_id", "url", "title", "relevance")


@query
def archive_candidates(spark, d):
    return intel.archive_candidates(topic.ranked_pages(table(spark, d, "pages"), TOPIC))


@query
def entity_sources(spark, d):
    """The union of sources of each merged entity, a row each, so that a frequent entity is no huge list."""
    found = entities.found(_texts(table(spark, d, "documents")))
    return found.groupBy("type", F.lower("value").alias("key"), "source").agg(F.max("confidence").alias("confidence"))


@query
def mention_counts(spark, d):
    return _texts(table(spark, d, "documents")).select(F.explode(T.mentions(F.col("text"))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query
def document_hashtags(spark, d):
    return _texts(table(spark, d, "documents")).select(F.explode(T.hashtags(F.col("text"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query
def document_domains(spark, d):
    return _texts(table(spark, d, "documents")).select("doc_id", F.explode(entities.domains(F.col("text"))).alias("domain"))


@query
def clean_captures(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.clean_capture(F.col("text")).alias("text"))


@query
def title_case_names(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.title_case(F.col("text")).alias("name"))


@query
def unique_turns(spark, d):
    turns = table(spark, d, "conversations").filter("conv_id is not null and text is not null").select("conv_id", "turn", "role", "text")
    return intel.unique_strings(turns, "conv_id", "text", ["turn", "role"]).select("conv_id", F.col("rank").cast("long").alias("rank"), "text")


@query
def continuation_cursor(spark, d):
    turns = table(spark, d, "conversations").filter("conv_id is not null").groupBy("conv_id", "turn").agg(F.max(F.length("text")).alias("n"))
    return intel.cursor(turns, "conv_id", "turn", F.coalesce(F.col("n") % 2 == 0, F.lit(False)), 3).select("conv_id", "turn", F.col("cursor").cast("long").alias("cursor"))
