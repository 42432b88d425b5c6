"""Dates in texts, dated events and the spans they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import B, E, bounded
from .facets import company_near

#: Months, in order, and the words that open and close an employment.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_NAMES = "|".join(f"{m}|{m[:3]}" for m in MONTHS) + "|sept"
START = r"(?i)\b(?:started|start(?:ed)?|joined|join(?:ed)?|hired|began|begin(?:ning)?|new job|now at|currently at|works? at|working at|employed (?:by|at)|accepted (?:a )?(?:role|position) at|posted (?:about )?(?:a )?job at)\b"
END = r"(?i)\b(?:left|quit|resigned|departed|former(?:ly)?|ex-|used to work|until|through|ended|no longer at|past role at|retired from)\b"
JOB_POST = r"(?i)\b(?:job (?:post(?:ing)?|listing|opening)|hiring|we(?:'re| are) hiring|apply (?:now|here)|careers? at)\b"
MOVED, FOUNDED = r"(?i)\b(?:lives in|moved to|relocated|based in)\b", r"(?i)\b(?:founded|LLC|Inc|startup|business)\b"
UNTIL, ROLE = r"(?i)\buntil\s*$", r"(?i)\b(?:as|role[:\s]+|position[:\s]+)\s+(?:a\s+)?([a-z][a-z\s/-]{2,40})"
#: Pattern, places of year, month and day in it, precision.
DATES = (
    (B + rf"({_NAMES})\.?\s+([0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+([0-9]{{4}})" + E, 3, 1, 2, "day"),
    (B + rf"([0-9]{{1,2}})(?:st|nd|rd|th)?\s+({_NAMES})\.?,?\s+([0-9]{{4}})" + E, 3, 2, 1, "day"),
    (B + r"([0-9]{4})-([0-9]{2})-([0-9]{2})" + E, 1, 2, 3, "day"),
    (B + r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})" + E, 3, 1, 2, "day"),
    (B + rf"({_NAMES})\.?\s+([0-9]{{4}})" + E, 2, 1, 0, "month"),
)


def _month(m: Column) -> Column:
    by_name = F.array_position(F.array(*(F.lit(x[:3]) for x in MONTHS)), F.substring(F.lower(m), 1, 3)).cast("int")
    return F.when(m.rlike("^[0-9]+$"), m.cast("int")).otherwise(by_name)


def dates(text: Column) -> Column:
    """(date, precision, match) in texts, by pattern and then by place; impossible dates are left out."""
    def of(pattern: str, year: int, month: int, day: int, precision: str) -> Column:
        part = lambda m, g: F.regexp_extract(m, f"(?i){pattern}", g)

        def one(m: Column) -> Column:
            date = F.try_to_date(F.concat_ws("-", part(m, year), F.lpad(_month(part(m, month)).cast("string"), 2, "0"), F.lpad(part(m, day), 2, "0") if day else F.lit("01")), "yyyy-MM-dd")
            return F.struct(date.alias("date"), F.lit(precision).alias("precision"), m.alias("match"))

        return F.transform(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(0)), one)

    every = [of(*x) for x in (*DATES, (r"datetime=\"([0-9]{4})-([0-9]{2})-([0-9]{2})\"", 1, 2, 3, "day"))]
    return F.filter(F.concat(*every), lambda x: x["date"].isNotNull())


def events(docs: DataFrame, reach: int = 140, base: float = 0.55) -> DataFrame:
    """Dated events of docs (doc_id, text): (doc_id, pos, date, precision, category, entity, role, confidence, detail).

    The words around a date, up to `reach` characters before and after the first place of what matched, tell its category: an employment that ends or starts, a job that is
    offered, a move, a firm, else general; and the firm and role that they name. A date with a firm is surer.
    """
    rows = docs.select("doc_id", "text", F.posexplode(dates(F.col("text"))).alias("pos", "d")).select("doc_id", "text", "pos", "d.*")
    rows = rows.withColumn("at", F.instr(F.col("text"), F.col("match")))
    before = F.substring(F.col("text"), F.greatest(F.col("at") - reach, F.lit(1)), F.least(F.col("at") - 1, F.lit(reach)))
    after = F.substring(F.col("text"), F.col("at") + F.length("match"), F.lit(reach))
    rows = rows.withColumn("before", before).withColumn("after", after)
    rows = rows.withColumn("detail", F.trim(F.regexp_replace(F.concat("before", "match", "after"), r"\s+", " ")))
    has = lambda c, pattern: F.col(c).rlike(bounded(pattern))
    job, end_before, start_after = has("after", JOB_POST), has("before", END), has("after", START) | has("after", JOB_POST)
    category = (
        F.when(has("before", UNTIL) | (end_before & ~start_after), "employment_end").when(job, "job_post").when(start_after | has("before", START), "employment_start")
        .when(end_before | has("after", END), "employment_end").when(has("detail", MOVED), "location").when(has("detail", FOUNDED), "business").otherwise("general")
    )
    near = {c: company_near(F.col(c)) for c in ("before", "after", "detail")}
    ended = F.col("category") == "employment_end"
    started = F.col("category").isin("employment_start", "job_post")
    entity = F.when(ended, F.coalesce(near["before"], near["detail"])).when(started, F.coalesce(near["after"], near["detail"])).otherwise(F.coalesce(near["after"], near["before"], near["detail"]))
    role = F.trim(F.regexp_extract(F.when(ended, F.col("before")).otherwise(F.col("after")), bounded(ROLE), 1))
    rows = rows.withColumn("category", category).withColumn("entity", entity)
    sure = F.when(F.col("entity").isNotNull(), F.lit(base) + 0.15).otherwise(F.lit(base))
    return rows.select("doc_id", "pos", "date", "precision", "category", "entity", F.when(role != "", role).alias("role"), sure.alias("confidence"), F.substring("detail", 1, 220).alias("detail"))


def employment(found: DataFrame) -> DataFrame:
    """(who, key, company, role, start, end, status) from dated events (who, seq, date, category, entity, role) and undated ones (date null) of category employment_current or employment_end.

    A firm's span begins with its first start or job offer, or, where there is none, with its first dated event of any kind, and ends with its last end. Status: current where something says so or
    it has a start and no end, past where it has both in order, else inferred_past.
    """
    kinds = ("employment_start", "employment_end", "employment_current", "job_post", "general")
    rows = found.filter(F.col("entity").isNotNull() & F.col("category").isin(*kinds)).withColumn("key", F.trim(F.regexp_replace(F.lower("entity"), "[^a-z0-9]+", " ")))
    date, opens = F.col("date"), F.col("category").isin("employment_start", "job_post")
    told = rows.groupBy("who", "key").agg(
        F.min_by("entity", "seq").alias("company"), F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"), F.min(F.when(opens, date)).alias("opened"), F.min(date).alias("first"),
        F.max(F.when(F.col("category") == "employment_end", date)).alias("end"), F.bool_or(F.col("category") == "employment_end").alias("ends"), F.bool_or(F.col("category") == "employment_current").alias("now"), F.bool_or(opens).alias("opens"),
    )
    told = told.withColumn("start", F.coalesce("opened", "first"))
    status = F.when(F.col("now") | (F.col("opens") & ~F.col("ends")), "current").when(F.col("end") >= F.col("start"), "past").otherwise("inferred_past")
    return told.select("who", "key", "company", "role", "start", "end", status.alias("status"))


def deduplicated(found: DataFrame, keys: list[str]) -> DataFrame:
    """The event of highest confidence for each key, the first by seq on ties."""
    best = F.max(F.struct("confidence", (-F.col("seq")).alias("order")))
    return found.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.confidence").alias("confidence"), (-F.col("b.order")).alias("seq"))


def spans(found: DataFrame) -> DataFrame:
    """(who, company, start, end, status) from events (who, company, category, date)."""
    key = F.trim(F.regexp_replace(F.lower("company"), "[^a-z0-9]+", " "))
    pick = lambda kind, f: f(F.when(F.col("category") == kind, F.col("date")))
    ends = found.groupBy("who", key.alias("company")).agg(pick("start", F.min).alias("start"), pick("end", F.max).alias("end"))
    status = F.when(F.col("end").isNotNull(), "past").when(F.col("start").isNotNull(), "current").otherwise("unknown")
    return ends.withColumn("status", status)


def transitions(found: DataFrame) -> DataFrame:
    """Moves from each span that ended to every later one, of another company, that began on or after its end.

    Spans of one person, of whom each company has one, meet once as an array; a person has as many as companies.
    """
    spans = found.filter("start is not null").groupBy("who").agg(F.array_sort(F.collect_list(F.struct("start", "company", "end"))).alias("spans"))
    pairs = spans.select("who", "spans", F.posexplode("spans").alias("i", "a")).filter("a.end is not null")
    later = F.filter(F.slice(F.col("spans"), F.col("i") + 2, F.size("spans")), lambda b: (b["company"] != F.col("a.company")) & (b["start"] >= F.col("a.end")))
    return pairs.select("who", F.col("a.company").alias("from_company"), F.explode(later).alias("b")).select("who", "from_company", F.col("b.company").alias("to_company"), F.col("b.start").alias("moved"))
