"""Captures of pages at points in time, and the lists that lead to pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept


def daily(captures: DataFrame, per_url: int = 10) -> DataFrame:
    """The first good capture (url, ts, status) of each url and day, the first per_url days."""
    ok = captures.filter("status = 200").withColumn("day", F.date_format("ts", "yyyyMMdd"))
    first = ok.groupBy("url", "day").agg(F.min("ts").alias("ts"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("ts"))).filter(F.col("n") <= per_url).drop("n")


def as_of(captures: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (url, at) the latest capture up to `at`, or the latest of all where at is null. Both sides are put in one order of time, so nothing is joined."""
    kind = captures.schema["ts"].dataType
    end = F.lit("9999-12-31 23:59:59").cast(kind)
    line = captures.select("url", F.col("ts").alias("t"), "ts", F.lit(None).cast(kind).alias("at"), F.lit(False).alias("asked"))
    line = line.union(wanted.select("url", F.coalesce(F.col("at").cast(kind), end), F.lit(None).cast(kind), F.col("at").cast(kind), F.lit(True)))
    before = Window.partitionBy("url").orderBy("t", "asked").rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("ts", F.last("ts", ignorenulls=True).over(before)).filter("asked and ts is not null").select("url", "at", "ts")


def archive_url(prefix: str, ts: Column, url: Column) -> Column:
    return F.concat_ws("/", F.lit(prefix), ts, url)


def cdx_rows(body: Column) -> Column:
    """The rows of a capture list (a JSON array of arrays whose first row names the fields)."""
    rows = F.from_json(body, "array<array<string>>")
    return F.when(F.size(rows) >= 2, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(F.array().cast("array<array<string>>"))


def sitemap_links(xml: Column, kind: str) -> Column:
    """The locations in a sitemap: kind is url or sitemap."""
    return F.xpath(xml, F.lit(f'//*[local-name()="{kind}"]/*[local-name()="loc"]/text()'))


def robots_sitemaps(text: Column) -> Column:
    """The whole addresses in the Sitemap lines of a robots file."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_extract(x, r"(?i)^\s*sitemap:\s*(\S+)", 1))), lambda x: x != "")


def sitemap_closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Distinct (url, level) that nested sitemaps lead to from start (url), however deep. edges: parent, child."""
    wave = kept(start.select("url").distinct())
    reached, level = wave.withColumn("level", F.lit(0)), 0
    while not wave.isEmpty():
        level += 1
        wave = kept(wave.join(edges, wave["url"] == edges["parent"]).select(F.col("child").alias("url")).distinct().join(reached, "url", "left_anti"))
        reached = reached.union(wave.withColumn("level", F.lit(level)))
    return reached


def resolved_seeds(wanted: DataFrame, seeds: DataFrame) -> DataFrame:
    """wanted (domain, ...) with seed: that of seeds (slug, seed) for the whole domain, else for its dotted parts from the right, else for "default"."""
    slugs = F.concat(F.array("domain"), F.reverse(F.split("domain", r"\.")), F.array(F.lit("default")))
    parts = wanted.select("domain", F.posexplode(slugs).alias("pos", "slug"))
    return wanted.join(parts.join(seeds, "slug").groupBy("domain").agg(F.min_by("seed", "pos").alias("seed")), "domain", "left")


def originals(captures: DataFrame, pattern: str, most: int = 30) -> DataFrame:
    """Addresses (url) like pattern that were captured with success, each once, the first `most` of them."""
    return captures.filter(F.col("url").like(pattern) & (F.col("status") == 200)).select("url").distinct().orderBy("url").limit(most)


def pairs(captures: DataFrame, pattern: str, most: int = 20) -> DataFrame:
    """(ts, url) of successful captures like pattern, each once, the oldest `most`."""
    return captures.filter(F.col("url").like(pattern) & (F.col("status") == 200)).select("ts", "url").distinct().orderBy("ts", "url").limit(most)
