"""Decisions over streams of requests: rates, spacing, replays, roles, chains."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept
from . import ordered

#: Ranks of roles, and the role that each route asks for; a route that is not listed asks for admin.
RANKS = {"viewer": 1, "operator": 2, "admin": 3, "sovereign": 4}
ROUTES = (
    ("GET /health", "viewer"), ("GET /organism/vitals", "viewer"), ("GET /v1/engines", "viewer"), ("GET /v1/jobs", "operator"), ("GET /v1/jobs/:id", "operator"),
    ("GET /v1/jobs/:id/pages", "operator"), ("POST /v1/jobs", "operator"), ("POST /v1/lookup", "operator"), ("GET /v1/audit", "admin"),
)


def window_counts(hits: DataFrame, key: str, at: Column, seconds: int = 60) -> DataFrame:
    """hits with n_window: how many of a key's hits lie in the `seconds` up to each."""
    w = Window.partitionBy(key).orderBy("at_s").rangeBetween(-seconds, 0)
    return hits.withColumn("at_s", at).withColumn("n_window", F.count(F.lit(1)).over(w))


def slots(hits: DataFrame, key: str, at: Column, interval: float, order: list[str]) -> DataFrame:
    """When each hit may go if a key's hits are at least interval apart: a running maximum, no loop."""
    w = Window.partitionBy(key).orderBy("at_s", *order)
    n = F.row_number().over(w)
    rows = hits.withColumn("at_s", at).withColumn("_n", n)
    free = F.max(F.col("at_s") - F.col("_n") * F.lit(interval)).over(w)
    return rows.withColumn("slot", free + F.col("_n") * F.lit(interval)).drop("_n")


def replayed(requests: DataFrame, nonce: str, at: Column, ttl: int = 120, order: str = "event_id") -> DataFrame:
    """requests with replay: the nonce was seen at most ttl seconds before."""
    w = Window.partitionBy(nonce).orderBy("at_s", order)
    before = F.lag("at_s").over(w)
    return requests.withColumn("at_s", at).withColumn("replay", F.coalesce(F.col("at_s") - before <= ttl, F.lit(False)))


def needed_role(method: Column, path: Column) -> Column:
    """The role for a route: exact, else the first listed pattern with an id whose beginning the path has, else admin."""
    key = F.concat_ws(" ", F.upper(method), path)
    out = None
    for route, role in ROUTES:
        out = (F.when(key == route, role) if out is None else out.when(key == route, role))
    for route, role in ROUTES:
        if ":id" in route:
            out = out.when(path.startswith(route.split(" ")[1].replace(":id", "").rstrip("/")), role)
    return out.otherwise("admin")


def rank(role: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair))
    return F.coalesce(table[role], F.lit(0))


def authorized(roles: Column, method: Column, path: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(roles, rank)) >= rank(needed_role(method, path)), F.lit(False))


def mac(key: bytes, message: Column) -> Column:
    """The keyed hash (HMAC with SHA-256) of a text in lower-case hex: two hashes over the padded key, as a Column."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


GENESIS = "GENESIS"


def signed(key: bytes) -> Column:
    """The keyed hash of an entry (id, at, kind, prev, detail)."""
    prev = F.when(F.coalesce("prev", F.lit("")) == "", GENESIS).otherwise(F.col("prev"))
    return mac(key, F.concat_ws("|", "id", "at", "kind", prev, F.coalesce("detail", F.lit(""))))


def chained(entries: DataFrame, key: bytes, *order: str) -> DataFrame:
    """entries (id, at, kind, detail: texts) with prev, the id of the entry before in the order ("" for the first), and their mac."""
    linked = ordered.before(ordered.in_order(entries, *order), "prev", F.col("id"))
    return linked.withColumn("prev", F.coalesce("prev", F.lit(""))).withColumn("mac", signed(key)).drop("place", "part")


def chain_faults(entries: DataFrame, key: bytes, *order: str) -> DataFrame:
    """(order..., id, fault) of a chain's entries: mac where the keyed hash differs, link where prev is not the id of the entry before. Ranges are checked apart, their borders compared."""
    linked = ordered.before(ordered.in_order(entries, *order), "expected", F.col("id"))
    wrong = F.array_compact(F.array(F.when(~F.col("mac").eqNullSafe(signed(key)), "mac"), F.when(~F.coalesce("prev", F.lit("")).eqNullSafe(F.coalesce("expected", F.lit(""))), "link")))
    return linked.select(*order, "id", F.explode(wrong).alias("fault"))


def vital(faults: DataFrame, dev: bool, *order: str) -> DataFrame:
    """(vital, reason): whether work may go on, as no fault of the chain is found; else the first fault. In development it always may."""
    first = faults.agg(F.min_by(F.concat_ws(" ", "id", "fault"), F.struct(*order, F.col("fault") == "link")).alias("reason"))
    return first.select((F.col("reason").isNull() | F.lit(dev)).alias("vital"), F.when(~F.lit(dev), F.col("reason")).alias("reason"))


def broken_links(events: DataFrame) -> DataFrame:
    """Where an audit chain breaks: events (chain, seq, id, prev) whose prev is not the id before."""
    before = F.lag("id").over(Window.partitionBy("chain").orderBy("seq"))
    return events.withColumn("expected", before).filter(~F.col("prev").eqNullSafe(F.col("expected")))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, host, path) with allowed: the longest rule (host, prefix, allow) decides, allowing on ties; true without rules.

    A host's rules are folded into one array, the longest first, so urls aren't multiplied by rules; each url takes the first that fits.
    """
    folded = rules.groupBy("host").agg(F.reverse(F.sort_array(F.collect_set(F.struct(F.length("prefix").alias("n"), "allow", "prefix")))).alias("rules"))
    fits = F.try_element_at(F.filter("rules", lambda r: F.col("path").startswith(r["prefix"])), F.lit(1))
    return urls.join(folded, "host", "left").select("url", F.coalesce(fits["allow"], F.lit(True)).alias("allowed"))


def admitted(requests: DataFrame, per_window: int, open_at_once: int, window: float = 60.0) -> DataFrame:
    """requests (id, at, until: seconds) with admitted: fewer than per_window admissions lie in the window up to `at`, and fewer than open_at_once are open.

    What is admitted depends on earlier admissions, so a busy period is a sequence; where nothing asked can still count, a new period begins. Periods are told by a running
    maximum in ranges and are worked on side by side; one streams through its task, which keeps at most per_window times and open_at_once ends. A connection is closed
    before a request of the same time. Requests of one time come by id; as within it nothing is freed that a later one finds taken, and no more than per_window are admitted,
    those behind the first per_window of a time are refused and do not enter the sequence.
    """
    placed = kept(requests.select("id", "at", "until").withColumn("turn", F.row_number().over(Window.partitionBy("at").orderBy("id"))))
    refused = placed.filter(F.col("turn") > per_window).select("id", F.lit(False).alias("admitted"))
    first = placed.filter(F.col("turn") <= per_window).drop("turn")
    line = ordered.before(ordered.in_order(first, "at", "id"), "busy", F.greatest(F.col("at") + F.lit(window), F.col("until")), greatest=True)
    starts = line.withColumn("start", F.col("busy").isNull() | (F.col("at") > F.col("busy")))
    period = ordered.before(starts, "period", F.when(F.col("start"), F.col("place")), greatest=True)
    period = period.withColumn("period", F.when(F.col("start"), F.col("place")).otherwise(F.col("period")))
    kind = requests.schema["id"].dataType.simpleString()

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, times, ends = None, deque(), []
        for frame in frames:
            out = []
            for part, at, until in zip(frame["period"], frame["at"], frame["until"]):
                if part != now:
                    now, times, ends = part, deque(), []
                while times and times[0] < at - window:
                    times.popleft()
                while ends and ends[0] <= at:
                    heappop(ends)
                good = len(times) < per_window and len(ends) < open_at_once
                if good:
                    times.append(at)
                    heappush(ends, until)
                out.append(good)
            yield pd.DataFrame({"id": frame["id"], "admitted": out})

    rows = period.select("id", F.col("at").cast("double"), F.col("until").cast("double"), "period", "place").repartition("period").sortWithinPartitions("period", "place")
    return rows.select("id", "at", "until", "period").mapInPandas(told, f"id {kind}, admitted boolean").unionByName(refused)


#: Paths that every request may have.
OPEN_PATHS = ("/health", "/organism/vitals")


def decision(path: Column, method: Column, admitted: Column, vital: Column, listed: Column, roles: Column, asks: bool = True) -> Column:
    """What a request meets first, or ok: RATE_LIMITED, ORGANISM_LOCKDOWN, CLIENT_NOT_ALLOWLISTED, UNAUTHORIZED (roles null: no known key, where a key is asked for), FORBIDDEN."""
    bare = F.substring_index(path, "?", 1)
    return (
        F.when(bare.isin(*OPEN_PATHS), "ok").when(~admitted, "RATE_LIMITED").when(~vital, "ORGANISM_LOCKDOWN").when(~listed, "CLIENT_NOT_ALLOWLISTED")
        .when(F.lit(asks) & roles.isNull(), "UNAUTHORIZED").when(~authorized(roles, method, bare), "FORBIDDEN").otherwise("ok")
    )
