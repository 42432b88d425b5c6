"""Relevance of pages, addresses and sentences to a topic or question."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.binding import let
from ..functions.text import bounded


@dataclass(frozen=True)
class Topic:
    """A query split into terms and phrases on the driver; it is small and goes into plans as literals."""

    terms: tuple[str, ...]
    phrases: tuple[str, ...]
    slugs: tuple[str, ...]

    @staticmethod
    def parse(query: str) -> Topic:
        if not query.strip():
            raise ValueError("the topic is empty")
        terms = tuple(dict.fromkeys(t for t in (x.lower() for x in re.findall(r"[a-zA-Z0-9_@.-]+", query)) if len(t) > 1 and t not in T.TOPIC_STOP))
        words = query.split()
        runs = (" ".join(words[i : i + n]).lower() for n in (4, 3, 2) for i in range(len(words) - n + 1))
        phrases = tuple(dict.fromkeys(p for p in runs if len(p) > 4))
        pairs = ("-".join(terms[:2]), "-".join(terms[:3]), "_".join(terms[:2])) if len(terms) > 1 else ()
        return Topic(terms, phrases, tuple(dict.fromkeys((*pairs, *(t for t in terms if len(t) > 3)))))


def _hits(text: Column, needles: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for n in needles:
        total = total + F.when(text.contains(n), 1).otherwise(0)
    return total


def text_score(text: Column, topic: Topic) -> Column:
    def of(low: Column) -> Column:
        terms = F.least(F.lit(0.55), _hits(low, topic.terms) / F.lit(float(max(1, len(topic.terms)))) * 0.55)
        return F.least(F.lit(1.0), _hits(low, topic.phrases[:6]) * 0.35 + terms)

    return let(F.lower(F.coalesce(text, F.lit(""))), of)


def url_score(url: Column, topic: Topic) -> Column:
    return F.least(F.lit(1.0), text_score(url, topic) + _hits(F.lower(url), topic.slugs) * 0.25 + _hits(url, U.SOCIAL_HOSTS) * 0.05)


def link_score(url: Column, anchor: Column, topic: Topic) -> Column:
    social = F.when(_hits(url, U.SOCIAL_HOSTS) > 0, 0.08).otherwise(0.0)
    return F.least(F.lit(1.0), url_score(url, topic) * 0.65 + text_score(anchor, topic) * 0.35 + social)


def page_score(url: Column, title: Column, body: Column, topic: Topic) -> Column:
    return F.least(F.lit(1.0), text_score(title, topic) * 0.35 + text_score(body, topic) * 0.45 + url_score(url, topic) * 0.2)


def follow(url: Column, anchor: Column, topic: Topic, least: float | Column) -> Column:
    """Whether a link joins the frontier: no chrome, and a score of least, a little more off the social hosts."""
    social = let(U.host(url), lambda name: F.greatest(*(name.contains(h) for h in U.SOCIAL_HOSTS)))
    return ~U.is_noise(url) & (link_score(url, anchor, topic) >= F.when(social, least).otherwise(least + 0.05))


def profile_links(links: DataFrame, topic: Topic, least: float = 0.15, most: int = 20) -> DataFrame:
    """(page_id, target, score): the `most` best links of a page (page_id, target, host, anchor, pos) to social hosts, each address once; no chrome."""
    social = F.exists(F.array(*map(F.lit, U.SOCIAL_HOSTS)), lambda h: F.col("host").contains(h))
    scored = links.filter(social & ~U.is_noise(F.col("target"))).withColumn("score", link_score(F.col("target"), F.col("anchor"), topic)).filter(F.col("score") >= least)
    once = scored.groupBy("page_id", "target").agg(F.max("score").alias("score"), F.min_by("pos", F.struct(-F.col("score"), "pos")).alias("pos"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "pos"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= most).select("page_id", "target", "score")


def children(links: DataFrame, topic: Topic, least: float = 0.1, least_relevance: float = 0.1) -> DataFrame:
    """(page_id, url, depth, priority) of what a topic's crawl goes on to from links (page_id, depth, relevance, target, host, anchor, pos): profiles first, then
    links that are worth following, by their score; more of them on relevant pages. An address of a page has its highest priority; nothing blocked."""
    fine = links.filter(U.blocked_reason(F.col("target")).isNull())
    depth = links.select("page_id", "depth").distinct()
    first = profile_links(fine, topic).join(depth, "page_id").select("page_id", F.col("target").alias("url"), "depth", (90 - F.col("depth")).cast("double").alias("priority"))
    score = link_score(F.col("target"), F.col("anchor"), topic)
    threshold = F.when(F.coalesce(F.col("relevance") >= least_relevance, F.lit(False)), least * 0.6).otherwise(least)
    others = fine.withColumn("least", threshold).filter(follow(F.col("target"), F.col("anchor"), topic, F.col("least"))).select("page_id", F.col("target").alias("url"), "depth", (F.floor(score * 100 + 0.5) - F.col("depth")).cast("double").alias("priority"))
    return first.unionByName(others).groupBy("page_id", "url").agg((F.max("depth") + 1).alias("depth"), F.max("priority").cast("long").alias("priority"))


def thousandths(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def ranked_pages(pages: DataFrame, topic: Topic, least: float = 0.12) -> DataFrame:
    """pages (page_id, url, html) with title and relevance of at least `least`. The score is told before a generator, past which no filter goes, so it is reckoned once."""
    scored = pages.withColumn("title", T.title(F.col("html"))).withColumn("exact", page_score(F.col("url"), F.col("title"), F.col("html"), topic)).drop("html")
    rows = scored.select(*(c for c in scored.columns if c != "exact"), F.explode(F.array("exact")).alias("exact"))
    return rows.filter(F.col("exact") >= least).withColumn("relevance", thousandths(F.col("exact"))).drop("exact")


#: Fixed values of the sentence ranking.
DEFINITION = rf"(?i){T.B}(is|are|was|were|means|refer(s)?\s+to|defined\s+as|consists\s+of|involves|describes|known\s+as){T.E}"
NOISE = r"(?i)\b(github|click here|sign up|subscribe|cookie|privacy policy|terms of service|download now|get started|our platform|self-evolving memory|portable memory layer)\b"
ACADEMIC = r"(?i)\b(comments:\s*\d+\s+pages|subjects:|figures,\s+\d+\s+appendices|arxiv:|doi:|(?:vol\.|pp\.)\s*\d)\b"
PRODUCT, LIST_PAGE = r"(?i)\b(modular|runtime|repository|repo|agent|platform)\b", r"(?i)\/list\/\w+\/new"
QUESTION = r"(?i)^(?:what\s+(?:is|are)|who\s+(?:is|are)|define|explain(?:\s+what)?|describe|tell\s+me\s+about)\s+(.+?)\??$"
EDUCATIONAL = r"(?i)(?:^|\.)((?:arxiv|britannica|wikipedia|worldhistory|paperswithcode|nature|ncbi|nih)\.(?:org|com|gov))"


def defines(sentence: Column) -> Column:
    return sentence.rlike(DEFINITION)  # "x is a ..." has it, too


def style(sentence: Column, url: Column) -> Column:
    """What a sentence is worth as a definition, whatever the question."""
    points = lambda holds, n: F.when(holds, n).otherwise(0)
    product = sentence.rlike(bounded(PRODUCT)) & ~sentence.rlike(DEFINITION)
    by_url = points(F.lower(url).contains("github.com"), -5) + points(url.rlike(LIST_PAGE), -4)
    return points(defines(sentence), 4) + points(sentence.rlike(bounded(NOISE)), -6) + points(sentence.rlike(bounded(ACADEMIC)), -5) + points(product, -2) + by_url


def host_points(url: Column, seed_hosts: list[str]) -> Column:
    """One point for educational hosts (as the address's own text tells), two for hosts of seeds and below them."""
    seeded = F.when(U.within(U.bare_host(url), seed_hosts), 2).otherwise(0) if seed_hosts else F.lit(0)
    return F.when(url.rlike(EDUCATIONAL), 1).otherwise(0) + seeded


@dataclass(frozen=True)
class Question:
    terms: tuple[str, ...]
    focus: str
    definition: bool

    @staticmethod
    def parse(question: str) -> Question:
        m = re.match(QUESTION, question.strip())
        focus = m[1].rstrip("?").strip() if m else question.strip()
        terms = tuple(dict.fromkeys(t for t in re.findall(r"[a-z0-9]{3,}", focus.lower()) if t not in T.QUESTION_STOP))
        return Question(terms, focus, bool(m))


def matches(text: Column, term: str) -> Column:
    """Whether a term occurs, with or without a plural s."""
    other = term[:-1] if term.endswith("s") and len(term) > 4 else term if term.endswith("s") else f"{term}s"
    return text.contains(term) | text.contains(other)


def sentence_score(sentence: Column, title: Column, url: Column, q: Question, seed_hosts: list[str] = ()) -> Column:
    if not q.terms:
        return F.lit(0.0)
    low, head = F.lower(sentence), F.lower(F.coalesce(title, F.lit("")))
    n = sum((F.when(matches(low, t) | matches(head, t), 1).otherwise(0) for t in q.terms), F.lit(0))
    score = n + n / F.lit(float(len(q.terms))) * 2 + F.when(_hits(head, q.terms) > 0, 1.5).otherwise(0.0) + host_points(url, list(seed_hosts))
    if q.definition:
        score = score + style(sentence, url) + F.when(low.contains(q.focus.lower()), 2).otherwise(0)
    return F.when(n > 0, score.cast("double")).otherwise(0.0)


def ranked_sentences(docs: DataFrame, question: str, most: int = 50, seed_hosts: list[str] = ()) -> DataFrame:
    """The best sentences of docs (doc_id, title, url, text): score, then length, then place."""
    q = Question.parse(question)
    rows = docs.select("doc_id", "title", "url", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    if q.definition:
        rows = rows.filter(defines(F.col("sentence")))
    scored = rows.withColumn("score", sentence_score(F.col("sentence"), F.col("title"), F.col("url"), q, seed_hosts)).filter("score > 0")
    return scored.orderBy(F.desc("score"), F.length("sentence").desc(), "doc_id", "pos").limit(most)
