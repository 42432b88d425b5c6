"""Summaries of crawled pages: by address, region, heading and theme."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.text import B, E
from . import gates, regions

HEADING = r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"
#: Themes of what people write about.
THEMES = {
    "technology": r"ai|software|code|coding|developer|tech|startup|prompt|llm|machine learning",
    "business": r"business|entrepreneur|founder|ceo|marketing|sales|brand|llc|company",
    "family": r"family|kids|children|wife|husband|mom|dad|parent",
    "fitness": r"gym|workout|fitness|run|running|health|nutrition",
    "travel": r"travel|trip|vacation|flight|hotel|beach|explore",
    "politics": r"politics|election|vote|president|congress|policy",
    "creative": r"art|design|music|photo|photography|video|film|creative",
    "education": r"school|university|college|student|learn|course|degree",
}
FIRST_PERSON = r"i|me|my|mine|we|our|us"


def latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row by seq of each key: an upsert as a grouping. Nulls are equal to each other. Only what a key keeps is shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("row"))
    return best.select(*keys, *(F.col(f"row.{c}").alias(c) for c in rest))


def headings(html: Column) -> Column:
    clean = lambda h: F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]*>", ""), r"[ \t\n\r\f]+", " "))
    return F.transform(F.regexp_extract_all(html, F.lit(HEADING), F.lit(1)), clean)


def subtopics(pages: DataFrame, most: int = 30) -> DataFrame:
    """Headings of 8 to 120 characters, one spelling each: the first by page and place, and how many pages have it; the `most` first."""
    rows = pages.select("page_id", F.posexplode(headings(F.col("html"))).alias("pos", "heading")).filter(F.length("heading").between(8, 120))
    one = rows.groupBy(F.lower("heading").alias("key"), "page_id").agg(F.min(F.struct("page_id", "pos", "heading")).alias("first"))
    both = one.groupBy("key").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n_pages"))
    return both.orderBy("first.page_id", "first.pos").limit(most).select(F.col("first.heading").alias("heading"), "n_pages")


def by_address(ranked: DataFrame) -> DataFrame:
    """The first page of each normalised address, of those that are relevant."""
    return ranked.withColumn("address", U.normalized(F.col("url"))).groupBy("address").agg(F.min(F.struct("page_id", "title", "relevance")).alias("p")).select("address", "p.*")


def regional_sources(pages: DataFrame, ranked: DataFrame, most: int = 8) -> DataFrame:
    """The `most` best pages of each region by relevance; (region, rank, page_id, relevance)."""
    placed = pages.select("page_id", regions.region(F.col("url"), F.col("html")).alias("region")).join(ranked.select("page_id", "relevance"), "page_id")
    order = Window.partitionBy("region").orderBy(F.desc("relevance"), "page_id")
    return placed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("region", "rank", "page_id", "relevance")


def crawl_stats(pages: DataFrame) -> DataFrame:
    return pages.agg(
        F.count(F.lit(1)).alias("n_pages"), F.countDistinct(U.normalized(F.col("url"))).alias("n_urls"), F.countDistinct(U.host(F.col("url"))).alias("n_hosts"),
        F.count_if(U.is_live(F.col("url"))).alias("n_live"), F.sum(F.when(T.needs_js(F.col("html")), 1).otherwise(0)).alias("n_scripted"),
    )


def themes(docs: DataFrame, by: str) -> DataFrame:
    """(by, theme, n_docs): how many texts of a group touch a theme. One pass, one row a group and theme is shuffled per task."""
    low = F.lower("text")
    flags = docs.groupBy(by).agg(*(F.count_if(low.rlike(f"{B}({p}){E}")).alias(name) for name, p in THEMES.items()))
    return flags.unpivot([by], list(THEMES), "theme", "n_docs")


def voice(docs: DataFrame, by: str) -> DataFrame:
    """(by, n_docs, n_first_person): how often a group writes in the first person."""
    return docs.groupBy(by).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.regexp_count(F.lower("text"), F.lit(f"{B}({FIRST_PERSON}){E}")).cast("long")).alias("n_first_person"))


def live_documents(pages: DataFrame, least: int = 80) -> DataFrame:
    """(page_id, title, text) of live pages whose text has at least `least` characters; the title is the address where there is none."""
    rows = pages.filter(U.is_live(F.col("url"))).select("page_id", F.coalesce(T.title(F.col("html")), F.col("url")).alias("title"), T.plain_text(F.col("html")).alias("text"))
    return rows.filter(F.length("text") >= least)


def preflight(url: Column, allowed: list[str], blocked: list[str] = (), schemes: tuple[str, ...] = ("http", "https")) -> Column:
    """The first reason not to fetch, or ok: scheme, blocked host, hosts outside the allowed domains."""
    host = U.host(url)
    inside = F.lit(not allowed)
    for d in allowed:
        inside = inside | (host == d) | host.endswith(f".{d}")
    return F.when(~U.scheme(url).isin(*schemes), "scheme_not_allowed").when(host.isin(*blocked), "domain_blocked").when(~inside, "domain_not_allowed").otherwise("ok")


def regional_seeds(topic: Column) -> Column:
    """A search address for each region's encyclopedia."""
    query = F.replace(F.url_encode(F.trim(topic)), F.lit("+"), F.lit("%20"))
    return F.array_distinct(F.array(*(F.concat(F.lit(f"https://{wiki}.wikipedia.org/wiki/Special:Search?search="), query, F.lit("&fulltext=1")) for _, _, wiki, *_ in regions.REGIONS)))


def historic(events: DataFrame, most: int = 40) -> DataFrame:
    """(period, url, findings) of dated events (date, url, detail, seq): what is told of an address on a day, in order; the first `most` by their first event. Undated events don't count."""
    rows = events.filter("date is not null").groupBy(F.col("date").alias("period"), "url")
    told = F.transform(F.array_sort(F.collect_list(F.when(F.col("detail").isNotNull(), F.struct("seq", "detail")))), lambda x: x["detail"])
    return rows.agg(told.alias("findings"), F.min("seq").alias("seq")).orderBy("seq").limit(most).select("period", "url", "findings")


def checked(urls: DataFrame, rules: DataFrame, allowed: list[str], blocked: list[str] = ()) -> DataFrame:
    """(url, reason) of distinct urls (url): preflight()'s reason, else robots_disallowed where the host's rules (host, prefix, allow) say so, else ok."""
    rows = urls.select("url", U.host(F.col("url")).alias("host"), U.part(F.col("url"), 3).alias("path")).distinct()
    robots = gates.robots_allowed(rows, rules)
    return robots.select("url", F.when(preflight(F.col("url"), allowed, blocked) != "ok", preflight(F.col("url"), allowed, blocked)).when(~F.col("allowed"), "robots_disallowed").otherwise("ok").alias("reason"))
