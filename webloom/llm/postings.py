"""Benchmark decontamination by a positional inverted index. DataFrame functions only.

The index is a stored table of postings (term, doc_id, part, pos), a row for each place of a term; the end of a text is a
term of its own (0), whose place is the text's length in words. It holds the terms that the benchmark has, as no other
is ever looked up. A window of an item is searched from its rarest terms: the posting lists of the two rarest are shifted by the
terms' offsets and intersected, which leaves few places; the postings of the other terms are asked at those places alone. A place
where all terms stand at their offsets is a phrase match; where each stands at most `slack` words off, a proximity match.

part is a hash of the text, so that different texts of one id stay apart. A null or empty text has no words and is hit by
nothing; its row stays. Equal rows each get the same result. A null doc_id stays null. An item without words has no
window; items of equal ids count once, a null item_id as the empty text; equal windows of several items are searched once. Texts and
items of any length are taken whole. Empty tables give no rows, or rows without hits. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Fixed values of the contract: what parts words, and the letters that are lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: How many of a window's posting lists are intersected at first.
FIRST = 2
_DOC = ("doc_id", "part")


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; none for null."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def lexicon(items: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, term): the distinct words of items by number, and the end of a text, "", as 0."""
    found = items.select(F.explode(words(F.col(text_col))).alias("word")).distinct()
    numbered = found.select("word", (F.monotonically_increasing_id() + 1).alias("term"))
    return stored(numbered.union(items.sparkSession.range(1).select(F.lit("").alias("word"), F.col("id").alias("term"))), "lexicon")


def index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored postings (term, doc_id, part, pos) of docs for terms (word, term).

    No shuffle unless terms outgrow what Spark broadcasts by their size on disk; each partition of docs writes postings of its own.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("part"), F.concat(words(F.col(text_col)), F.array(F.lit(""))).alias("w"))
    places = rows.select(*_DOC, F.posexplode("w").alias("pos", "word"))
    return stored(places.join(terms, "word").select("term", *_DOC, "pos"), "postings")


def windows(items: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((window, words), (window, item)): distinct runs of `size` words, or all words of an item that has fewer, and the items they are of."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    by_words = stored(each.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("window", F.monotonically_increasing_id()), "windows")
    return by_words.select("window", "words"), by_words.select("window", F.explode("items").alias("item"))


def plan(wanted: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """(window, n, lists) of windows all of whose terms have postings: lists are (n_postings, word, term, offset), the rarest first, ties by word and offset."""
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n_postings"))
    known = stored(terms.join(counts, "term"), "frequencies")
    each = wanted.select("window", F.size("words").alias("n"), F.posexplode("words").alias("offset", "word")).join(known, "word")
    lists = each.groupBy("window", "n").agg(F.sort_array(F.collect_list(F.struct("n_postings", "word", "term", "offset"))).alias("lists"))
    return stored(lists.filter(F.size("lists") == F.col("n")), "plan")


def _bit(at: Column | int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at if isinstance(at, Column) else F.lit(at))


def search(postings: DataFrame, wanted: DataFrame, terms: DataFrame, slack: int = 1) -> DataFrame:
    """(window, doc_id, part, start, n, exact): where documents hold windows (of at most 60 words).

    start is where the window begins as its rarest term tells; exact where every term stands at its offset from there, else each
    stands at most `slack` words off.
    """
    lists = plan(wanted, terms, postings)
    place = ["window", "n", *_DOC, "start"]
    seen = [F.bit_or(_bit(F.col("k"))).alias("near"), F.bit_or(F.when(F.col("by") == 0, _bit(F.col("k"))).otherwise(F.lit(0).cast("long"))).alias("same")]
    off = F.array(*map(F.lit, range(-slack, slack + 1)))
    first = lists.select("window", "n", F.posexplode(F.slice("lists", 1, FIRST)).alias("k", "x"))
    first = first.select("window", "n", "k", "x.term", "x.offset", F.explode(F.when(F.col("k") == 0, F.array(F.lit(0))).otherwise(off)).alias("by"))
    few = postings.join(first, "term").withColumn("start", F.col("pos") - F.col("offset") + F.col("by")).groupBy(*place).agg(*seen)
    few = stored(few.filter(F.col("near") == _bit(F.least(F.col("n"), F.lit(FIRST))) - 1), "candidates")
    # the other terms are asked in the candidates' documents only, which a repeated row of documents doesn't repeat
    where = stored(few.select(*_DOC).distinct(), "candidate-documents")
    near_by = postings.alias("p").join(where.alias("w"), F.expr("p.doc_id <=> w.doc_id AND p.part = w.part"), "left_semi").distinct()
    asked = few.join(lists.select("window", F.posexplode(F.slice("lists", FIRST + 1, 64)).alias("k", "x")), "window")
    asked = asked.select(*place, (F.col("k") + FIRST).alias("k"), "x.term", "x.offset", F.explode(off).alias("by")).withColumn("pos", F.col("start") + F.col("offset") + F.col("by"))
    told = asked.alias("a").join(near_by.alias("p"), F.expr("a.doc_id <=> p.doc_id AND a.part = p.part AND a.term = p.term AND a.pos = p.pos"))
    told = told.select(*(F.col(f"a.{c}") for c in (*place, "k", "by"))).groupBy(*place).agg(*seen)
    every = _bit(F.col("n")) - 1
    both = few.unionByName(told).groupBy(*place).agg(F.bit_or("near").alias("near"), F.bit_or("same").alias("same"))
    return both.filter(F.col("near") == every).select(*place, (F.col("same") == every).alias("exact"))


def covered(found: DataFrame) -> DataFrame:
    """(doc_id, part, n_hit): how many words of a document lie in exact matches."""
    spans = found.filter("exact").groupBy(*_DOC, "start").agg(F.max("n").alias("n"))
    before = F.max(F.col("start") + F.col("n")).over(Window.partitionBy(*_DOC).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.col("start") + F.col("n") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    return spans.groupBy(*_DOC).agg(F.sum(F.greatest("new", F.lit(0))).alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, slack: int = 1) -> DataFrame:
    """(doc_id, n_words, n_hit, items, n_near) of docs (doc_id, text) for items (item_id, text), a row for each of docs.

    n_hit counts words in exact matches, items are the sorted ids of items that match exactly, n_near counts items with a match of either kind.
    """
    if size > 60:
        raise ValueError("windows are of at most 60 words")
    terms = lexicon(items)
    postings = index(docs, terms)
    wanted, of_items = windows(items, size)
    found = stored(search(postings, wanted, terms, slack), "matches")
    by_item = found.join(of_items, "window").groupBy(*_DOC, "item").agg(F.max("exact").alias("exact"))
    told = by_item.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"), F.count(F.lit(1)).alias("n_near"))
    hits = told.alias("t").join(covered(found).alias("c"), F.expr("t.doc_id <=> c.doc_id AND t.part = c.part"), "left").select("t.*", "c.n_hit")
    rows = postings.filter("term = 0").alias("d").join(hits.alias("h"), F.expr("d.doc_id <=> h.doc_id AND d.part = h.part"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c.split(".")[-1])
    return rows.select("d.doc_id", F.col("d.pos").cast("long").alias("n_words"), zero("h.n_hit"), F.coalesce("h.items", F.array().cast("array<string>")).alias("items"), zero("h.n_near"))
