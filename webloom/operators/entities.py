"""Entities found in texts by pattern, and their merging."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import B, E, bounded

#: Patterns of the extractors.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?1[-.\s]?)?(?:\(?[2-9]\d{2}\)?[-.\s]?)[2-9]\d{2}[-.\s]?\d{4}\b"
COMPENSATION = (
    r"(?i)\$\s?[\d,]+(?:\.\d{2})?\s*(?:\/\s?(?:hr|hour)|per hour|hourly)",
    r"(?i)\$\s?[\d,]+(?:k|,000)?\s*(?:\/\s?(?:yr|year)|per year|annually|salary)",
)
DOMAINS = {
    "Artificial Intelligence": r"(?i)\b(artificial intelligence|\bAI\b|machine learning|\bML\b|deep learning|neural network|LLM|large language model)",
    "Prompt Engineering": r"(?i)\b(prompt engineering|prompt expert|prompt design|chain-of-thought)",
    "Cybersecurity": r"(?i)\b(cybersecurity|infosec|penetration testing|OSINT|threat intelligence)",
    "Web Crawling & Data": r"(?i)\b(web scraping|crawling|spider|data extraction)",
    "Blockchain": r"(?i)\b(blockchain|cryptocurrency|web3|smart contract)",
    "Cloud & DevOps": r"(?i)\b(cloud computing|devops|kubernetes|docker|aws|azure|gcp)",
    "Finance": r"(?i)\b(finance|economics|investment|trading|accounting)",
    "Healthcare & Life Sciences": r"(?i)\b(medicine|healthcare|clinical|pharmaceutical|biology)",
    "Law & Policy": r"(?i)\b(law|legal|jurisprudence|litigation|regulation)",
}


def _first(found: Column, most: int | None) -> Column:
    return found if most is None else F.slice(found, 1, most)


def emails(text: Column, most: int | None = None) -> Column:
    """All addresses, or the first `most`; a text without the sign isn't searched."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)))
    return _first(F.when(text.contains("@"), found).otherwise(F.array().cast("array<string>")), most)


def phones(text: Column, most: int | None = None) -> Column:
    """Digit strings with ten or eleven digits that do not start like a year."""
    found = F.regexp_extract_all(text, F.lit(bounded(PHONE)), F.lit(0))
    digits = lambda p: F.regexp_replace(p, "[^0-9]", "")
    valid = F.array_distinct(F.filter(found, lambda p: F.length(digits(p)).isin(10, 11) & ~digits(p).rlike("^(19|20)[0-9]{2}")))
    return _first(F.when(text.rlike("[0-9]{4}"), valid).otherwise(F.array().cast("array<string>")), most)


def _starts(patterns: Iterable[str]) -> str:
    r"""Patterns of DOMAINS as one that looks only where a word starts, and there by the first letter: all their words begin with a letter, so \b in front is the start of a word."""
    words: dict[str, list[str]] = {}
    for w in (w for p in patterns for w in p.removeprefix(r"(?i)\b(").removesuffix(")").split("|")):
        plain = w.removeprefix(r"\b")
        words.setdefault(plain[0].lower(), []).append(plain[1:].removesuffix(r"\b") + (E if plain.endswith(r"\b") else ""))
    return "(?i)" + B + f"(?=[{''.join(sorted(words))}])(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(words.items())) + ")"


def domains(text: Column) -> Column:
    """Names of the fields that a text touches, in the order of the table. Most texts touch none, which one search tells."""
    found = F.array_compact(F.array(*(F.when(text.rlike(_starts([p])), F.lit(name)) for name, p in DOMAINS.items())))
    return F.when(text.rlike(_starts(DOMAINS.values())), found).otherwise(F.array().cast("array<string>"))


def found(docs: DataFrame) -> DataFrame:
    """(type, value, confidence, source, seq) of the entities of docs (doc_id, text)."""
    kinds = F.concat(
        F.transform(emails(F.col("text")), lambda v: F.struct(F.lit("email").alias("type"), v.alias("value"), F.lit(0.9).alias("confidence"))),
        F.transform(phones(F.col("text")), lambda v: F.struct(F.lit("phone").alias("type"), v.alias("value"), F.lit(0.85).alias("confidence"))),
        F.transform(domains(F.col("text")), lambda v: F.struct(F.lit("domain").alias("type"), v.alias("value"), F.lit(0.7).alias("confidence"))),
    )
    rows = docs.select("doc_id", F.posexplode(kinds).alias("pos", "e"))
    return rows.select("e.*", F.concat(F.lit("doc:"), F.col("doc_id")).alias("source"), F.struct("doc_id", "pos").alias("seq"))


def merged(entities: DataFrame) -> DataFrame:
    """One row per (type, value regardless of case): the first spelling, the highest confidence, the number of sources.

    Sources are counted after one row is left per entity and source, so a frequent entity is never one group of a task.
    """
    key = F.lower("value").alias("k")
    one = entities.groupBy("type", key, "source").agg(F.max("confidence").alias("confidence"), F.min(F.struct("seq", "value")).alias("first"))
    return one.groupBy("type", "k").agg(F.min("first").alias("first"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_sources")).select("type", F.col("first.value").alias("value"), "confidence", "n_sources")


#: How sure each kind of entity is, as a part of how sure its page is.
SURE = {"email": 0.85, "phone": 0.85, "handle": 0.7, "url": 0.75, "location": 0.75, "past_location": 0.75, "origin": 0.75, "connection": 0.72, "name": 0.9}
NAMED_TITLE, HANDLE, CODE_PROFILE = r"\(([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\)", r"(?:x\.com|twitter\.com)/([A-Za-z0-9_]{2,30})", r"(?i)github\.com/[^/]+$"


def page_entities(pages: DataFrame) -> DataFrame:
    """(type, value, confidence, source, seq) of the entities of pages (page_id, url, title, text, relevance, links: addresses): a page is as sure as 0.4 and its relevance, at most 0.95, and each kind is a part of that."""
    from . import facets

    text, sure = F.col("text"), F.least(F.lit(0.95), F.col("relevance") + 0.4)
    of = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), (sure * SURE[kind]).alias("confidence")))
    places = lambda kind: F.transform(F.filter(facets.places(text), lambda x: x["kind"] == kind), lambda x: x["value"])
    name = F.regexp_extract(F.coalesce("title", F.lit("")), NAMED_TITLE, 1)
    handles = F.filter(F.transform("links", lambda u: F.regexp_extract(u, HANDLE, 1)), lambda h: h != "")
    found = F.concat(
        of("name", F.when(name != "", F.array(name)).otherwise(F.array().cast("array<string>"))), of("email", emails(text)), of("phone", phones(text)), of("location", facets.current_places(text)),
        of("past_location", places("past")), of("origin", places("origin")), of("connection", F.transform(facets.connections(text), lambda c: F.concat_ws(": ", c["kind"], c["value"]))),
        of("url", F.filter("links", lambda u: u.rlike(CODE_PROFILE))), of("handle", F.transform(handles, lambda h: F.concat(F.lit("@"), h))),
    )
    rows = pages.select("page_id", F.col("url").alias("source"), F.posexplode(found).alias("pos", "e"))
    return rows.select("e.*", "source", F.struct("page_id", "pos").alias("seq"))
