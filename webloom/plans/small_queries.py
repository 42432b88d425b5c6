"""Queries on children of a topic's crawl, gates, checks before fetching, places, entities by page and findings by day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import entities, facets, gates, reports, topic
from ..sources.tables import spread, table
from .queries import TOPIC, _links
from .table_queries import PROFILES, ROUTES, _put, chosen

QUERIES = {}
PLACED = ("Based in {n}, Texas now.", "Offices in {n}, TX and Main ST.", "She works with {n} and others.", "A teammate {n} lives in {n}, Ohio.", "Nothing of {n} here.")


def query(f):
    QUERIES[f.__name__] = f
    return f


def _cited(spark, d):
    """Links of customers' pages: a profile and a plain address each, on a page for every ten customers."""
    k = F.col("c_custkey")
    forms = F.array(F.struct(_put(chosen(PROFILES, k), "{k}", k).alias("target"), F.lit("the tion of").alias("anchor")), F.struct(F.concat(F.lit("https://plain.net/the-tion-"), k).alias("target"), F.lit("of").alias("anchor")), F.struct(F.concat(F.lit("http://10.0.0.1/the-tion/"), k).alias("target"), F.lit("the tion of").alias("anchor")))
    rows = table(spark, d, "customer").select(F.floor(k / 10).alias("page_id"), F.posexplode(forms).alias("i", "l"), k.alias("k"))
    return rows.select("page_id", (F.col("k") * 3 + F.col("i")).alias("pos"), "l.target", U.host(F.col("l.target")).alias("host"), "l.anchor", (F.col("page_id") % 3).cast("int").alias("depth"), ((F.col("page_id") % 2) * 0.2).alias("relevance"))


@query
def profile_links(spark, d):
    return topic.profile_links(_cited(spark, d), TOPIC).select("page_id", "target", F.round("score", 6).alias("score"))


@query
def topic_children(spark, d):
    return topic.children(_cited(spark, d), TOPIC).select("page_id", "url", F.col("depth").cast("long").alias("depth"), "priority")


@query
def api_gate_decision(spark, d):
    rows = table(spark, d, "events").select("event_id", chosen(tuple(m for m, _ in ROUTES), F.col("event_id")).alias("method"), chosen(tuple(p for _, p in ROUTES), F.col("event_id")).alias("path"), "user_id")
    role = chosen(("viewer", "operator", "admin", None), F.col("user_id"))
    told = gates.decision(F.col("path"), F.col("method"), F.col("event_id") % 11 != 0, F.col("event_id") % 13 != 0, F.col("event_id") % 17 != 0, F.when(role.isNotNull(), F.array(role)))
    return rows.select("event_id", told.alias("told"))


@query
def preflight_checked(spark, d):
    urls = table(spark, d, "pages").select("url")
    rules = urls.select(U.host(F.col("url")).alias("host")).distinct().select("host", F.inline(F.array(F.struct(F.lit("/fr").alias("prefix"), F.lit(False).alias("allow")), F.struct(F.lit("/fr/1").alias("prefix"), F.lit(True).alias("allow")))))
    return reports.checked(urls, rules, ["example.com", "example.net"])


def _placed(spark, d):
    name = F.initcap(F.lower("c_mktsegment"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), _put(chosen(PLACED, F.col("c_custkey")), "{n}", name).alias("text"))


@query
def current_place_mentions(spark, d):
    return _placed(spark, d).select("id", F.explode(facets.current_places(F.col("text"))).alias("place"))


@query
def colleague_mentions(spark, d):
    return _placed(spark, d).select("id", F.inline(facets.colleagues(F.col("text"))))


@query
def page_entity_merge(spark, d):
    """Entities of a page for each customer, whose title, text and links name it, merged over all pages."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("Mail a"), k % 9, F.lit("@b.net or 415-555-01"), F.lpad((k % 7).cast("string"), 2, "0"), F.lit(". Member of Guild."))
    pages = spread(table(spark, d, "customer").select("c_custkey")).select(k.alias("page_id"), F.concat(F.lit("https://p.net/"), k).alias("url"), F.lit("About (Jane Roe)").alias("title"), text.alias("text"), ((k % 10) / 10).alias("relevance"), F.array(F.concat(F.lit("https://x.com/u"), k % 5), F.concat(F.lit("https://github.com/g"), k % 4)).alias("links"))
    return entities.merged(entities.page_entities(pages)).select("type", "value", F.round("confidence", 6).alias("confidence"), "n_sources")


@query
def historic_findings(spark, d):
    events = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat(F.lit("http://u"), F.col("user_id") % 3).alias("url"), F.when(F.col("event_id") % 4 > 0, F.concat("event_type", F.lit("-"), "event_id")).alias("detail"), F.col("event_id").alias("seq"))
    return reports.historic(events).select("period", "url", F.array_join("findings", ",").alias("findings"))
