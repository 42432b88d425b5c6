"""Organisations in texts: where they are named, what stands around them, and what all texts together tell of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.binding import let
from ..functions.text import bounded
from ..sources.tables import kept, spread
from . import matching

#: Legal forms; (pattern, kind of link, detail) of how a text ties an organisation to its subject; addresses; telephone numbers.
LEGAL_FORM = r"(?i)\b(LLC|L\.L\.C\.|Inc\.|Incorporated|Corp\.|Corporation|Company|Co\.|LP|LLP|PLLC)\b"
OWNERSHIP = (
    (r"(?i)\b(?:founder of|co-founder of|founded|started|launched|established|owner of|owns|my company|our company)\s+", "founder", "founder/owner language"),
    (r"(?i)\b(?:CEO|president|owner)\s+(?:of|at)\s+", "executive", "executive/owner title"),
    (r"(?i)\b(?:works? at|working at|employed at|employee of|staff at)\s+", "employee", "employment language"),
    (r"(?i)\b(?:registered agent|principal address|mailing address)[:\s]", "address_match", "registered filing address context"),
)
ADDRESS = r"(?i)\b(\d{1,5}\s+[A-Za-z0-9\s]+(?:St|Street|Ave|Avenue|Blvd|Boulevard|Dr|Drive|Rd|Road|Ln|Lane|Way|Ct|Court|Pl|Place|Cir|Circle)(?:\s+(?:Apt|Unit|Suite|Ste|#)\s?[A-Za-z0-9-]+)?[^,]*,?\s*[A-Za-z\s]+,?\s*(?:FL|Florida|[A-Z]{2})(?:\s+\d{5})?)\b"
REGISTERED = r"(?i)\b(?:registered|principal|mailing|agent)\b"
AFFILIATED = r"(?i)\b(?:affiliated|member of|partner)\b"
PHONE = r"(?:\+?1[-.\s]?)?(?:\(?[2-9]\d{2}\)?[-.\s]?)[2-9]\d{2}[-.\s]?\d{4}"


def mentions(orgs: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, norm, id, text) of the texts (id, text) that hold an organisation's name (name), or its normal form, regardless of case."""
    known = orgs.select("name").distinct().select("name", F.lower("name").alias("low"), names.organisation(F.col("name")).alias("norm"))
    needles = known.select("name", "norm", F.explode(F.array_distinct(F.array("low", "norm"))).alias("needle")).filter("needle <> ''")
    held = matching.containing(needles.select("needle"), texts.select("id", F.lower("text").alias("text"))).select("id", F.explode("needles").alias("needle"))
    pairs = held.join(needles, "needle").select("id", "name", "norm").distinct()
    return pairs.join(texts.select("id", "text"), "id").select("name", "norm", "id", "text")


def windows(text: Column, name: Column, norm: Column, reach: int = 200, most: int = 12) -> Column:
    """What stands within `reach` characters of the first `most` places of the name; where there is none, of the first place of its normal form of four characters and more."""

    def around(needle: Column, limit: int) -> Column:
        gaps = F.transform(F.split(F.lower(text), F.concat(F.lit(r"\Q"), needle, F.lit(r"\E")), F.lit(-1)), F.length)

        def cut(g: Column) -> Column:
            at = lambda k: F.aggregate(F.slice(g, F.lit(1), k), F.lit(0), lambda s, x: s + x) + (k - 1) * F.length(needle)
            piece = lambda p: F.substring(text, F.greatest(p - reach, F.lit(0)) + 1, F.least(p, F.lit(reach)) + F.length(needle) + reach)
            places = F.when(F.size(g) > 1, F.sequence(F.lit(1), F.least(F.size(g) - 1, F.lit(limit)))).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda k: let(at(k), piece))

        return let(gaps, cut)

    none = F.array().cast("array<string>")
    return let(around(F.lower(name), most), lambda w: F.when(F.size(w) > 0, w).when(F.length(norm) >= 4, around(norm, 1)).otherwise(none))


def _owns(norm: Column, terms: list[str]) -> Column:
    long_ = [t for t in terms if len(t) >= 4]
    return F.greatest(*(norm.contains(t) for t in long_), F.lit(False)) if long_ else F.lit(False)


def kind(name: Column, norm: Column, context: Column, terms: list[str]) -> Column:
    """What an organisation is to the topic, by the words around its name; null where they don't tell."""
    own, held, works = (context.rlike(bounded(p)) for p, *_ in OWNERSHIP[:3])
    legal = name.rlike(bounded(LEGAL_FORM))
    return (
        F.when(own | held, "owned_business").when(works, "employer").when(legal & _owns(norm, terms), "owned_business").when(legal, "registered_entity")
        .when(context.rlike(bounded(AFFILIATED)), "affiliation")
    )


def details(found: DataFrame, terms: list[str] = ()) -> DataFrame:
    """(name, norm, id, n_windows, kind, owned, form, links, addresses, phones) of each mention; kind is that of the last window that tells one."""
    name, norm, contexts = F.col("name"), F.col("norm"), F.col("contexts")
    rows = spread(found).withColumn("contexts", windows(F.col("text"), name, norm))
    told = F.filter(F.transform(contexts, lambda c: kind(name, norm, c, list(terms))), lambda k: k.isNotNull())
    rows = rows.withColumn("told", F.try_element_at(told, F.lit(-1)))
    form = lambda c: F.regexp_extract(c, bounded(LEGAL_FORM), 1)
    forms = F.filter(F.transform(F.concat(F.array("name"), contexts), form), lambda f: f != "")
    each = lambda pattern, group: F.flatten(F.transform(contexts, lambda c: F.regexp_extract_all(c, F.lit(bounded(pattern)), F.lit(group))))
    some = lambda p: F.exists(contexts, lambda c: c.rlike(bounded(p)))
    links = F.array_compact(F.array(*(F.when(some(p), F.lit(f"{link}: {detail}")) for p, link, detail in OWNERSHIP)))
    address = lambda c: F.transform(F.regexp_extract_all(c, F.lit(bounded(ADDRESS)), F.lit(1)), lambda a: F.struct(F.trim(F.regexp_replace(a, r"\s+", " ")).alias("address"), F.when(c.rlike(bounded(REGISTERED)), "registered").otherwise("business").alias("kind")))
    by_name = _owns(norm, list(terms))
    owned = (F.coalesce(F.col("told") == "owned_business", F.lit(False))) | by_name
    return rows.select(
        "name", "norm", "id", F.size(contexts).cast("long").alias("n_windows"), F.when(owned, "owned_business").otherwise(F.coalesce("told", F.lit("unknown"))).alias("kind"), owned.alias("owned"),
        F.replace(F.try_element_at(forms, F.lit(1)), F.lit("."), F.lit("")).alias("form"), links.alias("links"), F.array_distinct(F.flatten(F.transform(contexts, address))).alias("addresses"), F.array_distinct(each(PHONE, 0)).alias("phones"),
    )


def merged(told: DataFrame, businesses: DataFrame | None = None, most: int = 10) -> DataFrame:
    """(name, norm, kind, owned, form, n_texts, texts, links, phones, addresses) of each organisation over all its mentions.

    The kind and the form are those of the last mention (by id) that tells one; it is owned where any mention says so, or where one of businesses (name) holds
    its normal form or lies in it. Of texts the first `most` ids are listed. Lists are of distinct values; what one organisation has of them is one row.
    """
    told = kept(told)  # read five times
    known = F.when(F.col("kind") != "unknown", F.col("id"))
    one = told.groupBy("name", "norm").agg(
        F.max_by("kind", known).alias("kind"), F.bool_or("owned").alias("owned"), F.max_by("form", F.when(F.col("form").isNotNull(), F.col("id"))).alias("form"), F.count(F.lit(1)).alias("n_texts"),
    )
    first = told.select("name", "id", F.row_number().over(Window.partitionBy("name").orderBy("id")).alias("n")).filter(F.col("n") <= most).groupBy("name").agg(F.sort_array(F.collect_list("id")).alias("texts"))
    values = lambda c: told.select("name", F.explode(c).alias("v")).distinct().groupBy("name").agg(F.sort_array(F.collect_list("v")).alias(c))
    places = told.select("name", "id", F.posexplode("addresses").alias("pos", "a")).groupBy("name", F.lower("a.address").alias("k")).agg(F.min(F.struct("id", "pos", "a"))["a"].alias("a"))
    rows = one.join(first, "name", "left")
    for more in (values("links"), values("phones"), places.groupBy("name").agg(F.sort_array(F.collect_list("a")).alias("addresses"))):
        rows = rows.join(more, "name", "left")
    if businesses is not None:
        alike = mutual(told.select("norm").distinct(), businesses.select(names.organisation(F.col("name")).alias("other")).distinct()).select("norm").distinct()
        rows = rows.join(alike.withColumn("listed", F.lit(True)), "norm", "left").withColumn("owned", F.col("owned") | F.coalesce("listed", F.lit(False))).drop("listed")
    return rows.withColumn("kind", F.when(F.col("owned"), "owned_business").otherwise(F.coalesce("kind", F.lit("unknown"))))


def mutual(a: DataFrame, b: DataFrame) -> DataFrame:
    """(norm, other): of a (norm) and b (other), normal forms of which one holds the other."""
    inside = lambda needles, texts: matching.containing(needles.toDF("needle"), texts.toDF("id").withColumn("text", F.col("id"))).select("id", F.explode("needles").alias("needle"))
    a, b = a.select("norm").filter("norm <> ''").distinct(), b.select("other").filter("other <> ''").distinct()
    return inside(a, b).select(F.col("needle").alias("norm"), F.col("id").alias("other")).union(inside(b, a).select("id", "needle")).distinct()


def groups(orgs: DataFrame) -> DataFrame:
    """(norm, leader): normal forms of orgs (name) in groups that containment links, by the least of each group."""
    norms = orgs.select(names.organisation(F.col("name")).alias("norm")).filter("norm <> ''").distinct()
    pairs = mutual(norms, norms.select(F.col("norm").alias("other")))
    return matching.components(pairs.select(F.col("norm").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("norm"), F.col("component").alias("leader"))
