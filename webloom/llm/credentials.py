"""Secrets in texts: patterns of whole credentials, and weak parts that are reported only where they complement each other. DataFrame functions only.

Whole credentials (assign, access, hex) are found by pattern. Weak parts are identifiers (id), opaque values (value)
and endpoints (endpoint), each common in harmless text. Parts of one document are interval-joined: two parts are linked
when they lie within `reach` characters in the same paragraph-like scope (no blank line between them). A weak part is reported if
it is linked to a complement: a secret (value, assign or hex) to an identifier (id or access) or an endpoint, and
an identifier or endpoint to a secret.

Texts are read once; only parts, keyed by id and a hash of the text, are shuffled, and only those of documents that
hold a weak part. Positions are code points, ends exclusive. A null text counts as empty and has no spans. Rows that repeat an id
and a text get the same spans, found once. An empty table gives no rows. Other columns, whatever their names, are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, running, stored, whole

#: Fixed values of the contract: kinds in order, pattern, group that is measured, least length.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
WEAK = (
    ("id", r"""(?i:client_?id|app_?id|account_?id|user_?name|login|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})""", 0, 4),
    ("value", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20),
    ("endpoint", r"""(?i:https?|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]{4,}""", 0, 8),
)
KINDS = tuple(k for k, *_ in BASE + WEAK)
_SECRET, _PUBLIC = ("value", "assign", "hex"), ("id", "access", "endpoint")
SPAN = "array<struct<start:int,kind:int,end:int>>"


def found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of the leftmost, non-overlapping matches whose group has at least `least` characters.

    Places follow from the lengths of what lies between the matches. Text without a match is only searched once.
    """
    lengths = lambda x: F.transform(x, F.length)
    whole = lengths(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
    part = lengths(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1))) if group else None

    def placed(w: Column) -> Column:
        gaps = F.slice(lengths(F.split(text, pattern, -1)), F.lit(1), F.size(w))
        ends = running(F.zip_with(gaps, w, lambda g, n: g + n))
        spans = F.zip_with(ends, w, lambda e, n: F.struct((e - n).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), e.alias("end"), n.alias("n")))
        if part is not None:
            spans = F.zip_with(spans, part, lambda s, n: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), n.alias("n")))
        return F.transform(F.filter(spans, lambda s: s["n"] >= least), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    return F.when(text.rlike(pattern), let(whole, placed)).otherwise(F.array()).cast(SPAN)


def scoped(spans: Column, text: Column) -> Column:
    """array of struct (s, scope): spans by their start, and how many blank lines begin before each."""
    blank = r"\n[\x20\x09\r]*\n"
    # a blank line begins after the paragraphs and blank lines before it
    both = F.zip_with(F.transform(F.split(text, blank, -1), F.length), F.transform(F.regexp_extract_all(text, F.lit(f"({blank})"), F.lit(1)), F.length), lambda p, b: F.struct(p.alias("p"), F.coalesce(b, F.lit(0)).alias("b")))
    begins = let(both, lambda x: F.slice(F.zip_with(running(F.transform(x, lambda y: y["p"] + y["b"])), x, lambda e, y: e - y["b"]), F.lit(1), F.size(x) - 1))
    nothing = F.lit(None).cast("struct<start:int,kind:int,end:int>")
    events = F.sort_array(F.concat(F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("what"), s.alias("s"))), F.transform(begins, lambda b: F.struct(b.alias("at"), F.lit(0).alias("what"), nothing.alias("s")))))
    numbered = let(events, lambda e: F.zip_with(e, running(F.transform(e, lambda x: 1 - x["what"])), lambda x, n: F.struct(x["s"].alias("s"), n.alias("scope"))))
    return F.filter(numbered, lambda x: x["s"].isNotNull())


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(doc_id, text_hash, base, weak, parts) and what keep names; parts: all spans and their scopes, in texts with a weak part."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), *keep)
    spans = lambda kinds: F.concat(*(found(F.col("t"), *k) for k in kinds))
    rows = rows.withColumn("base", spans(BASE)).withColumn("weak", spans(WEAK))
    parts = F.when(F.size("weak") > 0, scoped(F.concat("base", "weak"), F.col("t")))
    return rows.withColumn("parts", parts).withColumn("text_hash", F.xxhash64("t")).drop("t")


def linked(scanned: DataFrame, reach: int = 200) -> DataFrame:
    """(doc_id, text_hash, more): the weak spans that a complement supports.

    Each part falls into every stretch of `reach` characters from its start to its end, secrets from `reach` before to `reach`
    after, so that the join is on (document, stretch); pairs meet in the first that both have and the distance is checked there.
    """
    held = scanned.filter(F.size("weak") > 0).select("doc_id", "text_hash", F.explode("parts").alias("x")).select("doc_id", "text_hash", "x.s", "x.scope")
    kind = F.get(F.array(*map(F.lit, KINDS)), F.col("s.kind"))
    parts = held.select("doc_id", "text_hash", "s", kind.alias("kind"), "scope").dropDuplicates(["doc_id", "text_hash", "s"])
    stretches = lambda kinds, more: parts.filter(F.col("kind").isin(*kinds)).withColumn("first", F.floor((F.col("s.start") - more) / reach)).withColumn("stretch", F.explode(F.sequence("first", F.floor((F.col("s.end") + more) / reach))))
    secret = stretches(_SECRET, reach)
    public = stretches(_PUBLIC, 0).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("s").alias("p"), F.col("scope").alias("z"), F.col("first").alias("f"), F.col("stretch").alias("b"))
    near = F.greatest(F.col("s.start") - F.col("p.end"), F.col("p.start") - F.col("s.end")) <= reach
    apart = (F.col("s.end") <= F.col("p.start")) | (F.col("p.end") <= F.col("s.start"))
    pairs = secret.join(public, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")) & (F.col("stretch") == F.col("b")) & (F.col("b") == F.greatest("first", "f")) & (F.col("scope") == F.col("z")) & near & apart)
    weak = pairs.select("doc_id", "text_hash", F.explode(F.array("s", "p")).alias("s")).filter(F.col("s.kind") >= len(BASE))
    return weak.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("s")).alias("more"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """(doc_id, base, more) of every row: spans of whole credentials and of linked weak parts."""
    scanned = stored(scan(docs, id_col, text_col), "secrets")
    return _with_links(scanned, reach).select("doc_id", "base", "more")


def _with_links(scanned: DataFrame, reach: int) -> DataFrame:
    more = linked(scanned, reach).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "more")
    # documents without weak parts keep out of the join's shuffle
    plain = scanned.filter(F.size("weak") == 0).withColumn("more", F.array().cast(SPAN))
    held = scanned.filter(F.size("weak") > 0).join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").drop("d", "h").withColumn("more", F.coalesce("more", F.array().cast(SPAN)))
    return plain.unionByName(held)


def redacted(docs: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", reach: int = 200) -> DataFrame:
    """docs with every reported span replaced by mark; overlapping spans by one. The length column, if there is one, follows. Other rows stay as they are."""
    scanned = scan(docs.select(whole(docs), id_col, text_col), id_col, text_col, keep=["row"])
    rows = _with_links(stored(scanned, "secrets"), reach)
    t = F.coalesce(F.col(f"row.{text_col}").cast("string"), F.lit(""))

    def cleaned(spans: Column) -> Column:
        """The text between the spans, with a mark for each that begins where no earlier one reaches."""
        ends = running(F.transform(spans, lambda x: x["end"]), F.greatest)
        pieces = lambda e: F.transform(spans, lambda x, i: let(F.when(i == 0, 0).otherwise(F.get(e, i - 1)), lambda at: F.when(x["start"] >= at, F.concat(F.substring(t, at + 1, x["start"] - at), F.lit(mark))).otherwise("")))
        return let(ends, lambda e: F.concat(F.array_join(pieces(e), ""), F.substring(t, F.element_at(e, -1) + 1, F.length(t))))

    clean = let(F.sort_array(F.concat("base", "more")), cleaned)
    rows = rows.withColumn("clean", F.when(F.size("base") + F.size("more") > 0, clean))
    kind = dict(docs.dtypes)
    new = {text_col: F.col("clean"), length_col: F.length("clean").cast(kind.get(length_col, "long"))}
    return rows.select(*(F.when(F.col("clean").isNotNull(), new[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
