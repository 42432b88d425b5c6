"""Queries on addresses, lists, policies, chains and names whose rows come from the tables: small lists of forms say what Spark makes of each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, social
from ..functions import text as T
from ..functions import urls as U
from ..operators import chat, entities, facets, frontier, gates, reports, timeline
from ..sources import archive
from ..sources.tables import table
from . import crawl as crawling
from .queries import _links, _texts

QUERIES = {}
#: Forms of addresses; {h} is a page's host and {k} its number.
ADDRESSES = (
    "http://127.0.0.1/{k}", "http://10.1.2.{k}/", "ftp://{h}/{k}", "https://h{k}.local/", "http://172.20.0.1/{k}", "http://192.168.1.1/{k}", "http://169.254.169.254/{k}",
    "https://{h}/tests/{k}", "https://{h}/{k}.png", "https://www.example.com/{k}", "https://{h}.fine.net/page/{k}", "nonsense {k}", "https://github.com/features/{k}", "http://localhost:8080/{k}",
)
#: Forms of links on a page.
LINKS = ("../a/b", "./x/./y", "x/../y/", "../../../z", "/p/./q/../r", "a/..", "%2e%2e/up", "//Other.net:80/x/../y", "?q={k}", "#top", "mailto:{k}", "d é/{k}", "HTTP://{k}.net/./")
#: Forms of social addresses, by the number of a customer.
PROFILES = (
    "https://x.com/Some_{k}", "https://www.facebook.com/groups/{k}", "https://facebook.com/some.{k}/", "https://www.linkedin.com/in/Some-{k}", "https://github.com/search", "https://github.com/Some-{k}",
    "https://m.youtube.com/@Chan{k}", "https://fosstodon.social/@Bob{k}", "https://mastodon.social/@Bob{k}", "https://www.tiktok.com/@t.{k}", "https://other.net/@x{k}", "https://www.threads.net/@A{k}?x=1",
)
CUES = ("tell me more about {t}", "What is {t}?", "ok", "I want to die, always", "my mother called", "I am tired of {t}", "why does {t} rain?", "{t}", "", "Hello there")
ASKED = ("how does {t} algorithm work", "Jane Doe, family in Ohio and {t}", "{t}", "what is quantum {t}", "find John Smith of {t}")
ROUTES = (("GET", "/health"), ("GET", "/v1/jobs"), ("get", "/v1/jobs/77"), ("GET", "/v1/audit"), ("GET", "/api/chat"), ("POST", "/v1/lookup"))
DATES = ("MMMM d, yyyy", "d MMMM yyyy", "M/d/yyyy", "MMMM yyyy", "yyyy-MM-dd", "'time datetime=\"'yyyy-MM-dd'\"'")
KEY = b"a key of the test chain"


def query(f):
    QUERIES[f.__name__] = f
    return f


def chosen(forms: tuple, number: Column) -> Column:
    """The form for a number, in turn."""
    return F.element_at(F.array(*map(F.lit, forms)), (F.pmod(number, F.lit(len(forms))) + 1).cast("int"))


def _put(form: Column, sign: str, value: Column) -> Column:
    return F.replace(form, F.lit(sign), value.cast("string"))


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("h"), F.explode(F.array(*map(F.lit, ADDRESSES))).alias("form"))
    return pages.select("page_id", _put(_put(F.col("form"), "{h}", F.col("h")), "{k}", F.col("page_id")).alias("url"))


@query
def ssrf_reason(spark, d):
    return _addresses(spark, d).select("url", F.coalesce(U.blocked_reason(F.col("url")), F.lit("ok")).alias("reason"))


@query
def live_url_flag(spark, d):
    return _addresses(spark, d).select("url", U.is_live(F.col("url")).alias("live"))


@query
def preflight_reason(spark, d):
    return _addresses(spark, d).select("url", reports.preflight(F.col("url"), ["fine.net", "example.com"], ["www.example.com"]).alias("reason"))


@query
def link_resolution(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", F.posexplode(F.array(*map(F.lit, LINKS))).alias("form", "link"))
    return pages.select("page_id", F.col("form").cast("long").alias("form"), U.resolved(F.col("url"), _put(F.col("link"), "{k}", F.col("page_id"))).alias("target")).filter("target is not null")


@query
def social_profiles(spark, d):
    rows = table(spark, d, "customer").select(_put(chosen(PROFILES, F.col("c_custkey")), "{k}", F.col("c_custkey")).alias("url")).distinct().withColumn("s", social.classified(F.col("url")))
    return rows.filter("s is not null").select("url", "s.platform", "s.username", social.profile_url(F.col("url")).alias("profile_url"))


@query
def knowledge_domains(spark, d):
    return _texts(table(spark, d, "documents")).select("doc_id", F.array_join(entities.domains(F.col("text")), "|").alias("domains"))


def _supplied(spark, d):
    suppliers = table(spark, d, "supplier")
    form = chosen(("{n} Works LLC", "{n}, Inc.", "{n} Corp", "{n}"), F.col("s_suppkey"))
    nation = table(spark, d, "nation").select(F.initcap(F.lower(F.replace("n_name", F.lit("_"), F.lit(" ")))).alias("n"), F.col("n_nationkey").alias("s_nationkey"))
    return suppliers.join(F.broadcast(nation), "s_nationkey").select(F.col("s_suppkey").alias("id"), _put(form, "{n}", F.concat("n", F.lit(" "), "s_suppkey")).alias("firm"), "s_acctbal")  # 25 nations


@query
def business_mentions(spark, d):
    said = _supplied(spark, d).select("id", F.concat(F.lit("We buy from "), "firm", F.lit(" now")).alias("text"))
    return said.select("id", F.inline(facets.named(F.col("text"), facets.BUSINESSES, 2)))


@query
def compensation_mentions(spark, d):
    paid = _supplied(spark, d).select("id", F.concat(F.lit("At "), "firm", F.lit(" pays $"), F.format_string("%.2f", F.abs("s_acctbal")), chosen(("/hr", " per\tyear", " annually", ""), F.col("id"))).alias("text"))
    return paid.select("id", F.inline(facets.named(F.col("text"), facets.PAY)))


@query
def hashtag_counts(spark, d):
    said = table(spark, d, "part").select(F.concat("p_brand", F.lit(" #"), F.replace("p_type", F.lit(" "), F.lit(" #")), F.lit(" #x")).alias("text"))
    return said.select(F.explode(T.hashtags(F.col("text"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query
def date_mentions(spark, d):
    parts = F.element_at(F.array(*(F.date_format("o_orderdate", f) for f in DATES)), (F.pmod("o_orderkey", F.lit(len(DATES))) + 1).cast("int"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.explode(timeline.dates(F.concat(F.lit("on "), parts, F.lit(".")))).alias("x"))
    return rows.select("id", F.date_format("x.date", "yyyy-MM-dd").alias("date"), "x.precision")


@query
def capture_list_rows(spark, d):
    """A capture list for each user's events, written and read back."""
    row = F.format_string('["%s","http://u%d/%s"]', F.date_format("ts", "yyyyMMddHHmmss"), "user_id", "event_type")
    body = table(spark, d, "events").groupBy(F.col("user_id").alias("id"), (F.col("event_id") % 64).alias("part")).agg(F.concat(F.lit('[["timestamp","original"],'), F.array_join(F.collect_list(row), ","), F.lit("]")).alias("body"))
    return body.select("id", F.explode(archive.cdx_rows(F.col("body"))).alias("r")).select("id", F.col("r")[0].alias("ts"), F.col("r")[1].alias("url"))


@query
def crawl_budgeted(spark, d):
    """A crawl over the links of pages that ends within its second wave as its budget is spent."""
    pages = table(spark, d, "pages").select("page_id", U.normalized(F.col("url")).alias("parent"))
    edges = _links(table(spark, d, "pages")).join(pages, "page_id").select("parent", F.col("target").alias("child"), F.lit(50).alias("priority")).distinct()
    seeds = pages.filter("page_id % 10 = 0").select(F.col("parent").alias("url"), F.lit(100).alias("priority"))
    return crawling.crawl(spark, seeds, edges, crawling.CrawlSpec(max_depth=9, max_pages=40, batch=30)).select("url", "depth", "wave")


@query
def api_key_verify(spark, d):
    token = F.concat(F.lit("key-"), F.col("c_custkey"))
    registry = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.sha2(token, 256).alias("hash"), F.lower("c_mktsegment").alias("role"))
    return table(spark, d, "customer").select("c_custkey", F.sha2(token, 256).alias("hash")).join(registry, "hash", "left").select("c_custkey", "hash", F.coalesce("role", F.lit("none")).alias("role"))


@query
def rbac_decision(spark, d):
    role = chosen(("viewer", "operator", "admin", "sovereign", "nobody"), F.col("user_id"))
    rows = table(spark, d, "events").select("event_id", role.alias("role"), chosen(tuple(m for m, _ in ROUTES), F.col("event_id")).alias("method"), chosen(tuple(p for _, p in ROUTES), F.col("event_id")).alias("path"))
    return rows.select("event_id", gates.needed_role(F.col("method"), F.col("path")).alias("needs"), gates.authorized(F.array("role"), F.col("method"), F.col("path")).alias("allowed"))


@query
def robots_decision(spark, d):
    urls = table(spark, d, "pages").select("url", U.host(F.col("url")).alias("host"), U.part(F.col("url"), 3).alias("path")).distinct()
    rules = urls.select("host", F.inline(F.array(*(F.struct(F.lit(p).alias("prefix"), F.lit(a).alias("allow")) for p, a in (("/", True), ("/fr", False), ("/fr/1", True), ("/en/", False), ("/en/", True), ("/de/2", False))))))
    return gates.robots_allowed(urls, rules.filter("length(host) % 3 > 0").distinct())


@query
def domain_seed_resolve(spark, d):
    """Seeds by region and nation: the slug, its parts from the right, else the default."""
    nations = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 regions
    slug = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("-"))
    wanted = nations.select(F.concat(slug("r_name"), F.lit("."), slug("n_name")).alias("domain"), "n_nationkey")
    one = nations.filter("n_nationkey % 3 = 0").select(slug("n_name").alias("slug"), F.concat(F.lit("https://n.net/"), slug("n_name")).alias("seed"))
    two = nations.filter("n_nationkey % 6 = 0").select(F.concat(slug("r_name"), F.lit("."), slug("n_name")).alias("slug"), F.concat(F.lit("https://whole.net/"), slug("n_name")).alias("seed"))
    regions = table(spark, d, "region").filter("r_regionkey % 2 = 0").select(slug("r_name").alias("slug"), F.concat(F.lit("https://r.net/"), slug("r_name")).alias("seed"))
    default = spark.range(1).select(F.lit("default").alias("slug"), F.lit("https://d.net/").alias("seed"))
    return archive.resolved_seeds(wanted, one.union(two).union(regions).union(default)).select("domain", "seed")


@query
def sitemap_nested(spark, d):
    """The world's map leads to regions, these to nations and these to customers, which lead back to the world."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c))
    edges = table(spark, d, "region").filter("r_regionkey < 3").select(F.lit("world").alias("parent"), name("r", "r_regionkey").alias("child"))
    edges = edges.union(table(spark, d, "nation").select(name("r", "n_regionkey"), name("n", "n_nationkey"))).union(table(spark, d, "customer").select(name("n", "c_nationkey"), name("c", "c_custkey")))
    edges = edges.union(table(spark, d, "customer").select(name("c", "c_custkey"), F.lit("world")))
    return archive.sitemap_closure(edges, spark.range(1).select(F.lit("world").alias("url")))


@query
def sitemap_locations(spark, d):
    """A sitemap for each page's host, of every seventh an index, written and read back."""
    rows = table(spark, d, "pages").select(U.host(F.col("url")).alias("host"), F.replace("url", F.lit("&"), F.lit("&amp;")).alias("url"), (F.col("page_id") % 7 == 0).alias("index"), (F.col("page_id") % 16).alias("part"))
    entry = F.when(F.col("index"), F.format_string("<sitemap><loc>%s</loc></sitemap>", "url")).otherwise(F.format_string("<url><lastmod>x</lastmod><loc>%s</loc></url>", "url"))
    maps = rows.groupBy("host", "part", "index").agg(F.array_join(F.collect_list(entry), "").alias("body"))
    xml = maps.select("host", F.when(F.col("index"), F.concat(F.lit("<sitemapindex>"), "body", F.lit("</sitemapindex>"))).otherwise(F.concat(F.lit("<urlset xmlns='http://s.net/'>"), "body", F.lit("</urlset>"))).alias("xml"))
    return xml.select("host", F.explode(F.concat(archive.sitemap_links(F.col("xml"), "url"), archive.sitemap_links(F.col("xml"), "sitemap"))).alias("loc"))


@query
def robots_sitemaps(spark, d):
    hosts = table(spark, d, "pages").select(U.host(F.col("url")).alias("host")).distinct()
    body = F.concat(F.lit("User-agent: *\nSitemap: https://"), "host", F.lit("/a.xml\nDisallow: /x\n  sitemap:http://"), "host", F.lit("/b.xml extra\n# sitemap none"))
    return hosts.select("host", F.explode(archive.robots_sitemaps(body)).alias("loc"))


@query
def regional_seeds(spark, d):
    topics = table(spark, d, "part").select(F.col("p_type").alias("topic")).distinct()
    return topics.select("topic", F.explode(reports.regional_seeds(F.col("topic"))).alias("seed"))


@query
def engine_select(spark, d):
    rows = table(spark, d, "events").select("event_id", chosen((None, "http", "auto", "scrapy", "playwright"), F.col("event_id")).alias("wanted"), chosen(("live", "wayback", "common_crawl"), F.col("user_id")).alias("source"), (F.col("value") > 50).alias("js"))
    return rows.select("event_id", frontier.engine(F.col("wanted"), F.col("source"), F.col("js")).alias("engine"))


@query
def firm_names(spark, d):
    rows = _supplied(spark, d)
    a, b = F.concat("id", F.lit(" North Street, Town.")), F.concat("id", chosen((" north st town 99999", " Long Ave", ", North Street"), F.col("id")))
    return rows.select("id", names.organisation(F.col("firm")).alias("key"), names.legal_form(F.col("firm")).alias("form"), names.address(a).alias("address"), names.overlap(a, b).alias("same_place"))


def _cued(spark, d):
    turns = table(spark, d, "conversations").filter("conv_id is not null").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return turns.withColumn("text", _put(chosen(CUES, F.col("conv_id") + F.col("turn")), "{t}", F.col("text")))


@query
def chat_mode(spark, d):
    return _cued(spark, d).select("conv_id", "turn", chat.mode(F.col("text")).alias("mode"), chat.rule(F.col("text")).alias("rule"))


@query
def search_mode_classify(spark, d):
    rows = table(spark, d, "part").select("p_partkey", _put(chosen(ASKED, F.col("p_partkey")), "{t}", F.lower("p_type")).alias("q"))
    return rows.select("p_partkey", chat.search_mode(F.col("q")).alias("mode"))


def _entries(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("e"), F.col("event_id")).alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("event_type").alias("kind"), F.col("props").alias("detail"), "event_id")


def _damaged_chain(spark, d):
    """The chain of all events without every 89th entry, and with changed details in every 97th."""
    signed = gates.chained(_entries(spark, d), KEY, "event_id")
    return signed.filter("event_id % 89 <> 0 or event_id = 0").withColumn("detail", F.when(F.col("event_id") % 97 == 5, "changed").otherwise(F.col("detail")))


@query
def audit_chain_append(spark, d):
    return gates.chained(_entries(spark, d), KEY, "event_id").select("id", "prev", "mac")


@query
def audit_chain_verify(spark, d):
    return gates.chain_faults(_damaged_chain(spark, d), KEY, "event_id").select("event_id", "id", "fault")


@query
def vital_state(spark, d):
    broken = gates.vital(gates.chain_faults(_damaged_chain(spark, d), KEY, "event_id"), False, "event_id").select(F.lit("broken").alias("chain"), "*")
    whole = gates.vital(gates.chain_faults(gates.chained(_entries(spark, d), KEY, "event_id"), KEY, "event_id"), False, "event_id").select(F.lit("whole").alias("chain"), "*")
    return broken.union(whole)


@query
def global_limiter(spark, d):
    """All events as one line of requests whose times are pressed together, so that they meet."""
    at = F.floor(F.unix_micros("ts") / 20_000_000).cast("double")
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(F.col("event_id").alias("id"), at.alias("at"), (at + (F.col("user_id") % 5) * 20 + 1).alias("until"))
    return gates.admitted(rows, 6, 4)


@query
def key_fingerprint(spark, d):
    """Fingerprints of the users of each type of event, and of the first 10 event numbers' parity, each twice over with other cases, blanks and repeats."""
    rows = table(spark, d, "events")
    users = rows.select(F.col("event_type").alias("who"), F.concat(F.lit(" K"), F.col("user_id")).alias("key"))
    again = rows.select(F.concat("event_type", F.lit("-again")).alias("who"), F.explode(F.array(F.concat(F.lit("k"), F.col("user_id"), F.lit("  ")), F.lit(" "))).alias("key"))
    return frontier.fingerprints(users.union(again), ["who"])
