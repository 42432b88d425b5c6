"""Texts and pages as Column functions. A word boundary is that of ASCII words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that questions and topics leave out.
QUESTION_STOP = ("the", "and", "for", "are", "you", "what", "how", "why", "can", "does", "was", "were", "who", "when", "where", "which", "that", "this", "about")
TOPIC_STOP = ("a", "an", "the", "and", "or", "in", "on", "at", "to", "for", "of", "about")
#: Marks of pages that scripts build.
FRAMEWORKS = r"(?i)react|angular|vue|next\.js|nuxt|__NEXT_DATA__|window\.__INITIAL_STATE__"
B, E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def bounded(pattern: str) -> str:
    r"""pattern with \b as the boundary of ASCII words."""
    return pattern.replace(r"\b", _EDGE)


def title(html: Column) -> Column:
    found = F.trim(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1))
    return F.when(found != "", found)


def html_lang(html: Column) -> Column:
    found = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\slang=[\"']([^\"']+)[\"']", 1))
    return F.when(found != "", found)


def content_hash(html: Column) -> Column:
    return F.sha2(F.encode(html, "UTF-8"), 256)


def plain_text(html: Column, most: int | None = None) -> Column:
    """Whole text, or its first `most` characters, without chrome and tags, white space collapsed; texts that are no markup are only collapsed."""
    text = html
    for tag in ("script", "style", "nav", "footer", "header", "noscript", "iframe", "svg"):
        text = F.regexp_replace(text, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    squeeze = lambda x: F.trim(F.regexp_replace(x, r"[ \t\n\r\f]+", " "))
    whole = F.when(F.trim(html).startswith("<"), squeeze(text)).otherwise(squeeze(html))
    return whole if most is None else F.substring(whole, 1, most)


def needs_js(html: Column) -> Column:
    head = html
    return (F.length(html) < 500) | (head.rlike("(?i)<noscript") & (F.regexp_count(head, F.lit(r"(?i)<a\s+href=")) < 3)) | head.rlike(FRAMEWORKS)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0)), lambda t: ~t.isin(*QUESTION_STOP)))


def sentences(text: Column, least: int = 40, most: int = 520) -> Column:
    parts = F.transform(F.split(F.regexp_replace(text, r"[ \t\n\r\f]+", " "), r"(?<=[.!?]) +"), lambda s: F.trim(s))  # not F.trim itself: its second parameter would get the index
    return F.filter(parts, lambda s: F.length(s).between(least, most))


def topic_terms(query: Column) -> Column:
    found = F.regexp_extract_all(query, F.lit("[a-zA-Z0-9_@.-]+"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda t: (F.length(t) > 1) & ~t.isin(*TOPIC_STOP)))


def topic_phrases(query: Column) -> Column:
    """Distinct runs of four, three and two words."""
    words = F.split(F.trim(query), r"[ \t\n\r\f]+")

    def runs(size: int) -> Column:
        n = F.size(words) - size + 1
        at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.lower(F.array_join(F.slice(words, i, size), " ")))

    return F.array_distinct(F.filter(F.concat(runs(4), runs(3), runs(2)), lambda p: F.length(p) > 4))


def slugs(terms: Column) -> Column:
    few = lambda n, sep: F.array_join(F.slice(terms, 1, n), sep)
    pairs = F.when(F.size(terms) >= 2, F.array(few(2, "-"), few(3, "-"), few(2, "_"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(pairs, F.filter(terms, lambda t: F.length(t) > 3)))


def links(html: Column) -> Column:
    """(href, anchor) of the anchors of a page, in order."""
    tag = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"'>]*)[\"'][^>]*>(.*?)</a>"
    href, anchor = F.regexp_extract_all(html, F.lit(tag), F.lit(1)), F.regexp_extract_all(html, F.lit(tag), F.lit(2))
    clean = F.transform(anchor, lambda a: F.trim(F.regexp_replace(F.regexp_replace(a, "<[^>]*>", ""), r"[ \t\n\r\f]+", " ")))
    return F.arrays_zip(href.alias("href"), clean.alias("anchor"))


def hashtags(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"#([a-zA-Z0-9_]{2,40})"), F.lit(1)), F.lower))


def path_slug(topic: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(topic), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 60)


def mentions(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"@([a-zA-Z0-9_]{2,30})"), F.lit(1)), F.lower))


def clean_capture(text: Column) -> Column:
    """White space collapsed, and no points, commas or semicolons at the end."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " ")), r"[.,;]+$", "")


def title_case(name: Column) -> Column:
    """Every word with a capital and small letters, one blank between."""
    words = F.filter(F.split(name, r"[ \t\n\r\f]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")
