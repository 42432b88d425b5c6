"""What a page tells about a topic: description, headings, snippets, claims; and which strings and sources are worth keeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.binding import let
from .topic import Topic


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def description(html: Column) -> Column:
    """The content of the page's description, or of its og:description; null where there is neither."""
    named = lambda name: F.regexp_extract(html, rf"(?is)<meta[^>]*(?:name|property)=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)
    filled = lambda name: let(F.trim(named(name)), lambda x: F.when(x != "", x))
    return F.coalesce(filled("description"), filled("og:description"))


def headings(html: Column, most: int = 10) -> Column:
    """Texts of the first headings: all of the first level, then of the second, then of the third."""
    of = lambda level: F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<h{level}[^>]*>(.*?)</h{level}>"), F.lit(1)), lambda h: _squeezed(F.regexp_replace(h, "<[^>]*>", "")))
    return F.slice(F.filter(F.concat(of(1), of(2), of(3)), lambda h: h != ""), 1, most)


def snippets(text: Column, topic: Topic, before: int = 80, after: int = 120, most: int = 8) -> Column:
    """What stands around the first places of each term of three letters and more, term by term; distinct, `most` in all.

    Places follow from the lengths of what lies between them; no more than `most` of a term can be shown.
    """
    low = F.lower(text)

    def around(term: str) -> Column:
        gaps = F.slice(F.transform(F.split(low, rf"\Q{term}\E", -1), F.length), 1, most + 1)
        place = lambda k: F.aggregate(F.slice(gaps, F.lit(1), k), F.lit(0), lambda s, x: s + x) + (k - 1) * len(term)
        places = F.when(F.size(gaps) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(1))), place)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda at: F.trim(F.substring(text, F.greatest(at - before, F.lit(0)) + 1, F.least(at, F.lit(before)) + after)))

    found = [around(t) for t in topic.terms if len(t) >= 3]
    return F.slice(F.array_distinct(F.filter(F.concat(*found), lambda x: x != "")), 1, most) if found else F.array().cast("array<string>")


def claims(html: Column, title: Column) -> Column:
    """Statements of a page: a description of 30 characters and more, cut at 240, and a title of 15 and more, cut at 160."""
    return stated(description(html), title)


def stated(description: Column, title: Column) -> Column:
    """claims() of a page's description and title."""
    told = let(description, lambda x: F.when(F.length(x) >= 30, F.substring(x, 1, 240)))
    return F.array_compact(F.array(told, F.when(F.length(title) >= 15, F.substring(title, 1, 160))))


def unique_strings(rows: DataFrame, by: str, text: str, order: list[str], least: int = 12, most: int = 5) -> DataFrame:
    """(by, text, rank): the first strings of each group that differ regardless of case and have `least` characters."""
    once = rows.filter(F.length(F.trim(text)) >= least).groupBy(by, F.lower(F.trim(text)).alias("k")).agg(F.min(F.struct(*order, F.trim(text).alias("t"))).alias("x"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*(f"x.{c}" for c in order), "k"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= most).select(by, F.col("x.t").alias(text), "rank")


def archive_candidates(ranked: DataFrame, most: int = 5) -> DataFrame:
    """(url, relevance): the most relevant live addresses, each once, whose older captures are worth a look."""
    live = ranked.filter(U.is_live(F.col("url"))).groupBy(U.normalized(F.col("url")).alias("url")).agg(F.max("relevance").alias("relevance"))
    return live.orderBy(F.desc("relevance"), "url").limit(most)


def accepted(pages: DataFrame) -> DataFrame:
    """pages (status, html, rendered, ...) with body: what was fetched where it is whole, what was rendered where it needs scripts; only answers of 200 to 399 with a body stay."""
    body = F.when(F.coalesce(T.needs_js(F.col("html")), F.lit(True)), F.coalesce("rendered", "html")).otherwise(F.col("html"))
    return pages.filter("status >= 200 and status < 400").withColumn("body", body).filter(F.length("body") > 0)


def seeded(seeds: DataFrame, sitemaps: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(url, priority): seeds at 100, addresses of site maps at 90, of snapshots at 70; an address once, at its highest."""
    all_ = [d.select("url", F.lit(p).alias("priority")) for d, p in ((seeds, 100), (sitemaps, 90), (snapshots, 70))]
    return all_[0].unionByName(all_[1]).unionByName(all_[2]).groupBy("url").agg(F.max("priority").alias("priority"))


def bundle(candidates: DataFrame, crawled: DataFrame) -> DataFrame:
    """Of candidates (url), those that are worth crawling: no chrome, nothing blocked, not crawled yet."""
    fine = candidates.select("url").distinct().filter(~U.is_noise(F.col("url")) & U.blocked_reason(F.col("url")).isNull())
    return fine.join(crawled.select("url").distinct(), "url", "left_anti")


def cursor(turns: DataFrame, by: str, order: str, continues: Column, n: int) -> DataFrame:
    """turns with cursor: of the turns that go on since the last that doesn't, how many there are, mod n. One pass a conversation."""
    w = Window.partitionBy(by).orderBy(order)
    marked = turns.withColumn("_on", continues.cast("int")).withColumn("_part", F.sum(F.when(~continues, 1).otherwise(0)).over(w))
    return marked.withColumn("cursor", F.pmod(F.sum("_on").over(Window.partitionBy(by, "_part").orderBy(order)), F.lit(n))).drop("_on", "_part")
