"""Named queries over the tables, each a thin use of an operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.binding import let
from ..operators import entities, frontier, gates, regions, timeline, topic
from ..sources import archive
from ..sources.tables import table
from . import crawl as crawling

TOPIC = topic.Topic.parse("the tion of")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("title"), F.lit("").alias("url"))


def _links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, anchor, target, host) of links with a target. Targets are told within the array, before the generator:
    what filters them later stays above it and doesn't repeat how they came to be."""
    base = F.struct(U.scheme(F.col("url")).alias("s"), U.part(F.col("url"), 2).alias("a"), U.part(F.col("url"), 3).alias("p"))
    told = let(base, lambda b: F.transform(T.links(F.col("html")), lambda l: F.struct(l["href"].alias("href"), l["anchor"].alias("anchor"), U.placed(b, l["href"]).alias("t"))))
    rows = pages.select("page_id", F.posexplode(told).alias("pos", "l"))
    return rows.select("page_id", "pos", "l.href", "l.anchor", F.col("l.t.url").alias("target"), F.col("l.t.host").alias("host")).filter("target is not null")


@query
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", U.normalized(F.col("url")).alias("url"))


@query
def url_host(spark, d):
    return table(spark, d, "pages").select("page_id", U.bare_host(F.col("url")).alias("host"))


@query
def host_page_counts(spark, d):
    return table(spark, d, "pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n_pages"))


@query
def noise_url_flag(spark, d):
    """Pages and what they link to, and each link as a picture and on the code host."""
    urls = _links(table(spark, d, "pages")).select(F.explode(F.array("target", F.concat("target", F.lit(".PNG?x")), F.replace("target", F.col("host"), F.lit("github.com/features"))))).union(table(spark, d, "pages").select("url"))
    return urls.toDF("url").distinct().select("url", U.is_noise(F.col("url")).alias("noise"))


@query
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", T.title(F.col("html")).alias("title"))


@query
def page_content_hash(spark, d):
    return table(spark, d, "pages").select("page_id", T.content_hash(F.col("html")).alias("content_hash"))


@query
def content_shard_counts(spark, d):
    return table(spark, d, "pages").groupBy(F.substring(T.content_hash(F.col("html")), 1, 2).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query
def page_html_lang(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_lang(F.col("html")).alias("lang"))


@query
def page_plain_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.plain_text(F.col("html")).alias("text"))


@query
def needs_js_flag(spark, d):
    return table(spark, d, "pages").select("page_id", T.needs_js(F.col("html")).alias("needs_js"))


@query
def link_edges(spark, d):
    rows = _links(table(spark, d, "pages"))
    return rows.groupBy("page_id", "target").agg(F.min("pos").cast("long").alias("pos"))


@query
def link_outdegree(spark, d):
    rows = _links(table(spark, d, "pages")).select("page_id", "target").distinct()
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))


@query
def link_indegree(spark, d):
    rows = _links(table(spark, d, "pages")).select("page_id", "target").distinct()
    return rows.groupBy("target").agg(F.count(F.lit(1)).alias("n_pages"))


@query
def link_anchor_last(spark, d):
    rows = _links(table(spark, d, "pages"))
    return rows.groupBy("page_id", "target").agg(F.min("pos").cast("long").alias("pos"), F.max_by("anchor", "pos").alias("anchor"))


@query
def child_cap_per_page(spark, d):
    scored = _links(table(spark, d, "pages")).withColumn("priority", F.round(topic.link_score(F.col("target"), F.col("anchor"), TOPIC) * 100))
    kept = frontier.capped(scored.select("page_id", F.col("target").alias("url"), "priority", "pos"), 3)
    return kept.select("page_id", "url", F.col("priority").cast("int").alias("priority"), F.col("rank").cast("int").alias("rank"))


@query
def topic_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.topic_terms(F.col("text")), " ").alias("terms"))


@query
def topic_phrases(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.topic_phrases(F.col("text")), "|").alias("phrases"))


@query
def topic_slugs(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.slugs(T.topic_terms(F.col("text"))), "|").alias("slugs"))


@query
def topic_page_ranking(spark, d):
    ranked = topic.ranked_pages(table(spark, d, "pages"), TOPIC)
    return ranked.orderBy(F.desc("relevance"), "page_id").limit(20).select("page_id", "title", "relevance")


@query
def topic_report_stats(spark, d):
    ranked = topic.ranked_pages(table(spark, d, "pages"), TOPIC)
    return ranked.agg(F.count(F.lit(1)).alias("n_pages"), F.countDistinct(U.host(F.col("url"))).alias("n_hosts"), F.max("relevance").alias("best"))


@query
def topic_follow_links(spark, d):
    rows = _links(table(spark, d, "pages")).filter(topic.follow(F.col("target"), F.col("anchor"), TOPIC, 0.1))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_followed"))


@query
def doc_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens(F.coalesce("text", F.lit("")))).cast("long").alias("n_tokens"))


@query
def doc_sentences(spark, d):
    rows = _texts(table(spark, d, "documents")).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"))


@query
def sentence_topk(spark, d):
    ranked = topic.ranked_sentences(_texts(table(spark, d, "documents")), "thing ingthe hationtion")
    return ranked.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence", "score")


@query
def definition_topk(spark, d):
    ranked = topic.ranked_sentences(_texts(table(spark, d, "documents")), "what is thing")
    return ranked.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence", "score")


@query
def entity_emails(spark, d):
    return _texts(table(spark, d, "documents")).select("doc_id", F.explode(entities.emails(F.col("text"))).alias("email"))


@query
def entity_phones(spark, d):
    return _texts(table(spark, d, "documents")).select("doc_id", F.explode(entities.phones(F.col("text"))).alias("phone"))


@query
def entity_merge(spark, d):
    return entities.merged(entities.found(_texts(table(spark, d, "documents"))))


@query
def region_counts(spark, d):
    return table(spark, d, "pages").groupBy(regions.region(F.col("url"), F.col("html")).alias("region")).agg(F.count(F.lit(1)).alias("n_pages"))


@query
def region_coverage(spark, d):
    return regions.coverage(region_counts(spark, d))


def _orders_text(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    verb = F.when(F.col("o_orderstatus") == "F", "Left the team on ").when(F.col("o_orderstatus") == "O", "Joined the team on ").otherwise("Met on ")
    return orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(verb, F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".")).alias("text"))


@query
def dated_events(spark, d):
    return timeline.events(_orders_text(spark, d)).select("doc_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "precision", "category")


@query
def dated_event_dedupe(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("seq"), "l_shipdate", F.col("l_returnflag").alias("category"), F.col("l_discount").alias("confidence"))
    found = lines.withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    return timeline.deduplicated(found, ["l_orderkey", "month", "category"])


def _employment(spark, d):
    orders = table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "end").when(F.col("o_orderstatus") == "O", "start").otherwise("general")
    return orders.select(F.col("o_custkey").alias("who"), F.col("o_orderpriority").alias("company"), kind.alias("category"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))


@query
def timeline_spans(spark, d):
    return timeline.spans(_employment(spark, d))


@query
def timeline_transitions(spark, d):
    return timeline.transitions(timeline.spans(_employment(spark, d)))


@query
def timeline_recent(spark, d):
    rows = timeline.spans(_employment(spark, d)).withColumn("shown", F.coalesce("end", F.lit("9999")))
    return rows.orderBy(F.desc("shown"), "who", "company").limit(50).select("who", "company", "shown")


def _captures(spark, d):
    events = table(spark, d, "events")
    status = F.when(F.col("event_id") % 7 == 0, 404).otherwise(200)
    return events.select(F.concat(F.lit("u"), F.col("user_id") % 20).alias("url"), "ts", status.alias("status"))


@query
def snapshot_daily_collapse(spark, d):
    return archive.daily(_captures(spark, d)).select("url", "day", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query
def snapshot_asof_latest(spark, d):
    captures = _captures(spark, d)
    wanted = captures.groupBy("url").agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("at"))
    both = wanted.union(wanted.select("url", F.lit(None).cast("timestamp_ntz").alias("at")))
    return archive.as_of(captures, both).select("url", F.col("at").isNull().alias("latest"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query
def frontier_dedupe(spark, d):
    rows = _links(table(spark, d, "pages")).select(F.lit(1).alias("job"), F.col("target").alias("url"), F.lit(None).cast("string").alias("ts"), (F.col("page_id") * 1000 + F.col("pos")).alias("seq"))
    have = table(spark, d, "pages").filter("page_id % 2 = 0").select(F.lit(1).alias("job"), U.normalized(F.col("url")).alias("url"), F.lit(None).cast("string").alias("ts"))
    return frontier.enqueued(have, rows, ["job", "url", "ts"]).select("url", "seq")


@query
def frontier_pop_topk(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("job"), F.floor("value").cast("long").alias("priority"), (F.col("user_id") % 4).cast("int").alias("depth"), F.col("event_id").alias("seq"))
    return frontier.popped(rows, 5, ["job"]).select("job", "priority", "depth", "seq")


@query
def crawl_reachability(spark, d):
    """What three steps over the links of captured pages reach from every fiftieth page."""
    pages = table(spark, d, "pages").select("page_id", U.normalized(F.col("url")).alias("parent"))
    edges = _links(table(spark, d, "pages")).join(pages, "page_id").select("parent", F.col("target").alias("child"), F.lit(50).alias("priority")).distinct()
    seeds = pages.filter("page_id % 50 = 0").select(F.col("parent").alias("url"), F.lit(100).alias("priority"))
    return crawling.crawl(spark, seeds, edges, crawling.CrawlSpec(max_pages=1_000_000_000, batch=1_000_000_000)).select("url", "depth")


@query
def crawl_saturation(spark, d):
    seen = table(spark, d, "events").select(F.floor(F.col("event_id") / 1000).cast("int").alias("wave"), F.concat(F.lit("k"), F.col("user_id")).alias("key"))
    return crawling.saturation(seen).select("wave", F.col("n_new").cast("long").alias("n_new"), "saturated")


@query
def pages_limit_offset(spark, d):
    return table(spark, d, "pages").orderBy("page_id").offset(20).limit(10).select("page_id", "url")


@query
def jobs_latest_status(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("job"), F.struct("o_orderdate", "o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    return orders.groupBy("job").agg(F.max_by("status", "k").alias("status"), F.count(F.lit(1)).alias("n_changes"))


def _second(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "ts"), F.unix_timestamp("ts")


@query
def rate_window_60s(spark, d):
    events, at = _second(spark, d)
    return gates.window_counts(events, "user_id", at).select("event_id", "n_window")


@query
def host_slot_spacing(spark, d):
    events, at = _second(spark, d)
    return gates.slots(events, "user_id", at, 500.0, ["event_id"]).select("event_id", F.round("slot").cast("long").alias("slot"))


@query
def replay_dedupe(spark, d):
    events, at = _second(spark, d)
    return gates.replayed(events, "user_id", at, 3600).select("event_id", "replay")


@query
def allowlist_semijoin(spark, d):
    listed = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return table(spark, d, "events").join(listed, "user_id", "left_semi").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _turns(spark, d):
    return table(spark, d, "conversations").filter("conv_id is not null")


@query
def chat_phrase_alternation(spark, d):
    turns = _turns(spark, d).filter("role = 'user'")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    return turns.select("conv_id", "turn", F.when((n - 1) % 2 == 0, "Tell me more.").otherwise("This is interesting.").alias("reply"))


@query
def network_edges_top(spark, d):
    top = topic.ranked_pages(table(spark, d, "pages"), TOPIC).orderBy(F.desc("relevance"), "page_id").limit(20).select("page_id")
    rows = _links(table(spark, d, "pages")).join(F.broadcast(top), "page_id")  # 20 rows
    return rows.groupBy("page_id", "target").agg(F.min("pos").alias("pos")).orderBy("page_id", "pos", "target").limit(100).select("page_id", "target")
