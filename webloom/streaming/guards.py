"""Guards over streams of requests, as Structured Streaming operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import gates


def first_seen(requests: DataFrame, nonce: list[str], at: str, ttl: str = "120 seconds") -> DataFrame:
    """requests without replays: a nonce counts again only once ttl has passed. State is dropped behind the watermark."""
    return requests.withWatermark(at, ttl).dropDuplicatesWithinWatermark(nonce)


def on_time(requests: DataFrame, sent: str, received: str, skew: int = 60) -> DataFrame:
    """requests whose clock is at most skew seconds off."""
    return requests.filter(F.abs(F.unix_timestamp(sent) - F.unix_timestamp(received)) <= skew)


def admitted(requests: DataFrame, client: str, at: str, most: int, seconds: int = 60, id_col: str = "event_id") -> DataFrame:
    """(client, id, admitted) of a stream of requests: at most `most` admitted ones of a client in any `seconds`.

    Requests that are denied don't count, so the answer depends on those before; a client's state is the times of its
    admitted requests in the window, at most `most` of them, and goes once the watermark is a window past its last request. Batches of a client
    come in their own order of time.
    """
    rows = requests.withWatermark(at, f"{seconds} seconds").select(F.col(client).cast("string").alias("client"), F.col(id_col).cast("long").alias("id"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(at).alias("at"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        hits = pd.concat(list(parts)).sort_values(["t", "id"])
        out = []
        for t in hits["t"]:
            held = [h for h in held if h >= t - seconds * 1_000_000]
            out.append(len(held) < most)
            if out[-1]:
                held.append(int(t))
        state.update((held,))
        state.setTimeoutTimestamp(max(int(hits["t"].iloc[-1]) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": key[0], "id": hits["id"], "admitted": out})

    return rows.groupBy("client").applyInPandasWithState(step, "client string, id long, admitted boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def chained(entries: DataFrame, key: bytes, chain: str = "chain", seq: str = "seq") -> DataFrame:
    """(chain, id, at, kind, detail, prev, mac) of a stream of audit entries (chain, seq, id, at, kind, detail: texts but seq): each names the entry before it in its chain.

    A chain's state is the id of its last entry. Entries of a batch are taken by seq; batches must come in order. The keyed hash is a Column expression over what state gives.
    """
    rows = entries.select(F.col(chain).cast("string").alias("chain"), F.col(seq).cast("long").alias("seq"), "id", "at", "kind", "detail")

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else ""
        hits = pd.concat(list(parts)).sort_values("seq")
        hits["prev"] = [last, *hits["id"][:-1]]
        state.update((hits["id"].iloc[-1],))
        yield hits[["chain", "id", "at", "kind", "detail", "prev"]]

    told = rows.groupBy("chain").applyInPandasWithState(step, "chain string, id string, at string, kind string, detail string, prev string", "last string", "append", GroupStateTimeout.NoTimeout)
    return told.withColumn("mac", gates.signed(key))
