"""Queries on what phrases name. The tables' texts hold no such phrases, so a sentence is told about each customer, by its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chat, facets
from ..sources.tables import spread, table

QUERIES = {}
#: Sentences told about customers; the sign stands for a name made of the market segment and the key.
SENTENCES = (
    "Works at {} since 2019 and was formerly at {} Labs.",
    "Founder of {}. A former engineer at {} Systems; salary: $85,000 per year.",
    "She is director of {}, a member of {} Guild, expert in data engineering.",
    "RT @someone: {} LLC, doing business as {} Shop, launched Rocket {}.",
    "Moved from Denver, born in Boston. Veteran, city of Austin, pays $25.50/hr at {}.",
    "Security researcher, headquarters at 12 Main Street {}, main line: 415-555-0199.",
    "Nothing to tell about the one below, {}.",
    "I'm with {} in a photo shared from home as partnered with {} Media.",
    "What is the history of the {} protocol?",
    "Employed by {} & Sons until May. Grew up in New Haven, roots in old Porto, niche: tea.",
    "Find the profile of John {} in Paris, Texas, France.",
)
ALT = ("", "my headshot", "view of a harbour", "a plan of motion")
IMAGES = ("https://cdn.example.org/media/{}.jpg", "https://cdn.example.org/icon-{}.png", "https://t.example.org/pixel?{}", "/local/{}.png", "https://cdn.example.org/u/{}/avatar.png", "https://cdn.example.org/{}.svg")


def query(f):
    QUERIES[f.__name__] = f
    return f


def _said(spark, d):
    name = F.concat(F.initcap(F.lower("c_mktsegment")), F.lit(" "), F.col("c_custkey").cast("string"))
    choice = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.pmod("c_custkey", F.lit(len(SENTENCES))) + 1).cast("int"))
    return spread(table(spark, d, "customer").select("c_custkey", "c_mktsegment")).select(F.col("c_custkey").alias("id"), name.alias("name"), F.replace(choice, F.lit("{}"), name).alias("text"))


def _kinds(spark, d, found):
    return _said(spark, d).select("id", F.inline(found(F.col("text"))))


@query
def connection_mentions(spark, d):
    return _kinds(spark, d, facets.connections)


@query
def past_employment_mentions(spark, d):
    return _kinds(spark, d, facets.past_employment)


@query
def expertise_mentions(spark, d):
    return _kinds(spark, d, lambda t: facets.named(t, facets.EXPERTISE))


@query
def organisation_mentions(spark, d):
    return _kinds(spark, d, lambda t: facets.named(t, facets.ORGANISATIONS))


@query
def business_kinds(spark, d):
    return _kinds(spark, d, lambda t: facets.named(t, facets.BUSINESSES, 2))


@query
def pay_mentions(spark, d):
    return _kinds(spark, d, lambda t: facets.named(t, facets.PAY))


@query
def workplace_mentions(spark, d):
    return _kinds(spark, d, facets.workplaces)


@query
def government_mentions(spark, d):
    return _kinds(spark, d, lambda t: facets.named(t, facets.GOVERNMENT))


@query
def place_mentions(spark, d):
    return _kinds(spark, d, facets.places)


@query
def company_names(spark, d):
    return _said(spark, d).select("id", F.explode(facets.company_names(F.col("text"))).alias("company"))


@query
def facet_counts(spark, d):
    """How many texts name each value of a facet: the maps of all facets, a row an entry."""
    tables = {"connection": facets.connections, "expertise": lambda t: facets.named(t, facets.EXPERTISE), "government": lambda t: facets.named(t, facets.GOVERNMENT), "place": facets.places}
    entry = lambda name: lambda x: F.struct(F.lit(name).alias("facet"), x["kind"].alias("kind"), F.lower(x["value"]).alias("value"))
    found = F.concat(*(F.transform(f(F.col("text")), entry(n)) for n, f in tables.items()))
    return _said(spark, d).select("id", F.inline(F.array_distinct(found))).groupBy("facet", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


@query
def repost_reasons(spark, d):
    return _said(spark, d).select("id", facets.repost_reason(F.col("text"), F.when(F.col("id") % 4 == 1, F.lit('{"is_retweet" : true}'))).alias("reason"))


def _images(spark, d):
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.floor(F.col("id") / n), F.lit(len(values))) + 1).cast("int"))
    return _said(spark, d).withColumn("image", F.replace(pick(IMAGES, 1), F.lit("{}"), F.col("id").cast("string"))).withColumn("alt", pick(ALT, 3))


@query
def post_images(spark, d):
    return _images(spark, d).filter(facets.is_post_image(F.col("image"))).select("id", "image")


@query
def self_images(spark, d):
    reason = facets.self_image_reason(F.col("image"), F.col("alt"), F.col("text"), ["motion", "of"], F.array(F.lit("7.jpg"), F.lit("")))
    return _images(spark, d).select("id", reason.alias("reason")).filter("reason is not null")


@query
def company_near_date(spark, d):
    return _said(spark, d).select("id", facets.company_near(F.col("text")).alias("company"))


@query
def json_unescaped(spark, d):
    escaped = F.concat_ws("", F.col("text"), F.lit('\\nsaid \\"so\\" \\\\n'))
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(facets.unescaped(escaped), "UTF-8")).alias("md5"))


@query
def address_organisations(spark, d):
    urls = _said(spark, d).withColumn("site", F.lower(F.regexp_replace("name", " ", "-")))
    n = F.col("id") % 4
    url = F.when(n == 0, F.concat(F.lit("https://GitHub.com/orgs/"), "site")).when(n == 1, F.concat(F.lit("https://github.com/"), "site", F.lit("/repo"))).when(n == 2, F.lit("https://github.com/features/x")).otherwise(F.concat(F.lit("https://"), "site", F.lit(".gov")))
    return urls.select("id", facets.organisation_of(url).alias("organisation"), facets.government_of(url).alias("government"))


@query
def search_mode_scores(spark, d):
    return _said(spark, d).select("id", chat.search_scores(F.col("text")).alias("s")).select("id", "s.mode", "s.confidence")
