"""Approximate nearest neighbours on robust-pruned directed graphs, one graph a shard, searched by beams.

Equal vectors are one node: partitions first cut their rows to the few smallest ids of each vector, so that copies,
however many, neither crowd a graph nor a task; no answer needs more, for nearness ties go to smaller ids. Nodes are dealt
to shards by a hash of their vector; a shard takes `shard_bytes` of vectors and links, as much as a task can hold, so that
there are as few graphs to search as may be: in a graph the work of a search hardly grows with its nodes. In a
shard, batches of nodes search the graph greedily from its centre for neighbour candidates, and robust pruning keeps a
candidate only if none that was kept is nearer to it, by a factor alpha, than the node is; links are then made
both ways and pruned again. A second pass with alpha over 1 adds long links.

The index is a table of one row per shard. Queries go through it in blocks: each (shard, block) pair is a row, in which
beam search proposes nodes, measured again in double precision, and the best of all shards are ranked.

Vectors that are null, empty, all zero or hold null or non-finite components take no part. Vectors of unequal lengths
are never compared. Rows that repeat an id and a vector count once; an id with several vectors is a candidate with each, and asks with the
smallest. Rows whose id is null are left out.
Empty tables give no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

HIT = "query_id long, vec_id long, score double"


def robust_prune(dist: np.ndarray, among: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Which candidates to keep, for a batch of nodes.

    dist (B, C): squared distances of a node's candidates, ascending, inf where there is none; among (B, C, C): squared distances of
    the candidates among each other. Nearest first, a kept candidate rules out those to which it is nearer by alpha.
    """
    alive = np.isfinite(dist)
    keep = np.zeros_like(alive)
    a2 = alpha * alpha
    left = np.full(len(dist), degree)
    for i in range(dist.shape[1]):
        now = alive[:, i] & (left > 0)
        keep[:, i] = now
        left -= now
        alive &= ~(now[:, None] & (a2 * among[:, i] <= dist))
    return keep


class Graph:
    """A directed graph over the rows of x."""

    def __init__(self, x: np.ndarray, links: np.ndarray, entry: np.ndarray):
        self.x, self.links, self.entry = x.astype(np.float32), links, entry
        self.norms = np.einsum("ij,ij->i", self.x, self.x)

    def _to(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its own nodes at (B, C); -1 is no node."""
        d = self.norms[at] - 2 * np.einsum("bcd,bd->bc", self.x[at], q) + np.einsum("bd,bd->b", q, q)[:, None]
        return np.where(at < 0, np.inf, np.maximum(d, 0))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, squared distances), ascending, of a beam search from the entry nodes for each row of q; -1 and inf pad."""
        q = q.astype(np.float32)
        rows = np.arange(len(q))[:, None]
        width = max(beam, len(self.entry))
        nodes = np.full((len(q), width), -1)
        nodes[:, : len(self.entry)] = self.entry
        dist = self._to(q, nodes)
        seen = nodes < 0
        met = np.zeros((len(q), len(self.x) + 1), bool)  # nodes that were measured; the last column is no node
        met[:, -1] = True
        met[rows, nodes] = True
        while True:
            open_ = np.where(seen, np.inf, dist)
            best = open_.argmin(1)
            busy = np.flatnonzero(np.isfinite(open_[rows[:, 0], best]))
            if not len(busy):
                break
            seen[busy, best[busy]] = True
            new = self.links[nodes[busy, best[busy]]]
            known = met[busy[:, None], new]
            met[busy[:, None], new] = True
            new = np.where(known, -1, new)
            d = np.concatenate([dist[busy], self._to(q[busy], new)], 1)
            n = np.concatenate([nodes[busy], new], 1)
            s = np.concatenate([seen[busy], new < 0], 1)
            top = np.argpartition(d, width - 1, axis=1)[:, :width]
            r = np.arange(len(busy))[:, None]
            dist[busy], nodes[busy], seen[busy] = d[r, top], n[r, top], s[r, top]
        order = np.argsort(dist, axis=1, kind="stable")
        return nodes[rows, order], dist[rows, order]

    def _pruned(self, of: np.ndarray, candidates: np.ndarray, alpha: float) -> None:
        """New links of nodes `of` from candidates (B, C); -1, the node itself and repeats are ignored."""
        degree = self.links.shape[1]
        candidates = np.where(candidates == of[:, None], -1, candidates)
        candidates = np.sort(candidates, axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        dist = self._to(self.x[of], candidates)
        order = np.argsort(dist, axis=1, kind="stable")
        r = np.arange(len(of))[:, None]
        candidates, dist = candidates[r, order], dist[r, order]
        c = self.x[candidates]
        n = self.norms[candidates]
        among = np.maximum(n[:, :, None] + n[:, None, :] - 2 * np.matmul(c, c.transpose(0, 2, 1)), 0)
        keep = robust_prune(dist, among, alpha, degree)
        order = np.argsort(~keep, axis=1, kind="stable")[:, :degree]
        chosen = np.where(keep[r, order], candidates[r, order], -1)
        self.links[of] = -1
        self.links[of, : chosen.shape[1]] = chosen

    def connect(self, batch: np.ndarray, beam: int, alpha: float) -> None:
        """Links a batch of nodes to what their searches find, and back."""
        found, _ = self.search(self.x[batch], beam)
        self._pruned(batch, np.concatenate([found, self.links[batch]], 1), alpha)
        to = self.links[batch]
        source, target = np.repeat(batch, to.shape[1])[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]
        order = np.lexsort((source, target))
        source, target = source[order], target[order]
        nodes, first, n = np.unique(target, return_index=True, return_counts=True)
        # nodes with ever more incoming links are taken in chunks of a few, so the matrices stay small
        step = self.links.shape[1]
        for k in range(0, int(n.max()) if len(n) else 0, step):
            part = n > k
            back = first[part][:, None] + k + np.arange(step)
            ok = back < (first[part] + n[part])[:, None]
            back = np.where(ok, source[np.minimum(back, len(source) - 1)], -1)
            self._pruned(nodes[part], np.concatenate([back, self.links[nodes[part]]], 1), alpha)


def build(x: np.ndarray, degree: int = 24, beam: int = 40, alpha: float = 1.2, batch: int = 256, seed: int = 5) -> Graph:
    """x: float rows, all different."""
    n = len(x)
    rng = np.random.default_rng(seed)
    links = np.full((n, degree), -1)
    if n > 1:
        links[:, : min(degree, 8)] = (np.arange(n)[:, None] + rng.integers(1, n, (n, min(degree, 8)))) % n
    centre = int(np.square(x - x.mean(0)).sum(1).argmin())
    entry = np.unique(np.concatenate([[centre], rng.permutation(n)[:15]]))
    graph = Graph(x, links, entry)
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            graph.connect(order[at : at + batch], beam, a)
    return graph


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): rows that take part, v as doubles."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())


def nodes(vectors: DataFrame, most: int) -> DataFrame:
    """(key, raw, ids): each vector once, as bytes of doubles, with the `most` smallest of its ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"raw": pa.array(list(held), pa.binary()), "ids": pa.array(list(held.values()), pa.list_(pa.int64()))})

        for batch in batches:
            column = batch.column("v")
            values, offsets = column.flatten().to_numpy() + 0.0, column.offsets.to_numpy() - column.offsets[0].as_py()
            for i, k in enumerate(batch.column("vec_id").to_pylist()):
                ids = held.setdefault(values[offsets[i] : offsets[i + 1]].tobytes(), [])
                if k not in ids:
                    ids.append(k)
                    if len(ids) > most:
                        ids.remove(max(ids))
            if len(held) > 50_000:
                yield out()
                held.clear()
        if held:
            yield out()

    cut = vectors.mapInArrow(task, "raw binary, ids array<long>")
    return cut.groupBy("raw").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"))


def index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", copies: int = 11, shard_bytes: int = 16 << 20, shard_size: int | None = None, **building) -> DataFrame:
    """A row per shard (width, shard, x, links, entry, offsets, ids), stored. Every usable row is in it.

    copies: how many ids of equal vectors are kept, one more than any query's k. shard_size: nodes of a shard, instead of shard_bytes.
    """
    table = stored(nodes(usable(vectors, id_col, vec_col), copies).withColumn("width", (F.length("raw") / 8).cast("int")), "nodes")
    most = lambda width: shard_size or max(1, shard_bytes // (8 * width + 256))
    shards = {r["width"]: max(1, math.ceil(r["count"] / most(r["width"]))) for r in table.groupBy("width").count().collect()}
    if not shards:
        shards = {0: 1}
    number = F.create_map(*(F.lit(x) for pair in shards.items() for x in pair))[F.col("width")]  # one entry per vector length

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("raw", ignore_index=True)
        x = np.frombuffer(b"".join(rows["raw"]), np.float64).reshape(len(rows), -1)
        graph = build(x, **building)
        ids = [np.sort(i) for i in rows["ids"]]
        offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        data = {"x": x, "links": graph.links.astype(np.int32), "entry": graph.entry.astype(np.int32), "offsets": offsets.astype(np.int64), "ids": np.concatenate(ids).astype(np.int64)}
        return pd.DataFrame([{"width": key[0], "shard": key[1]} | {k: v.tobytes() for k, v in data.items()}])

    dealt = table.withColumn("shard", F.pmod(F.xxhash64("raw"), number.cast("long")).cast("int"))
    made = dealt.groupBy("width", "shard").applyInPandas(make, "width int, shard int, x binary, links binary, entry binary, offsets binary, ids binary")
    return stored(made, "graphs")


def blocks(queries: DataFrame, size: int) -> DataFrame:
    """(width, block, ids, x): queries (vec_id, v) packed by blocks of about size."""
    counted = {r["width"]: max(1, math.ceil(r["count"] / size)) for r in queries.groupBy(F.size("v").alias("width")).count().collect()} or {0: 1}
    number = F.create_map(*(F.lit(x) for pair in counted.items() for x in pair))[F.size("v")]
    block = F.pmod(F.xxhash64("vec_id"), number.cast("long")).cast("int")
    return queries.groupBy(F.size("v").alias("width"), block.alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))


def search(graphs: DataFrame, queries: DataFrame, k: int = 10, beam: int = 48, block: int = 2048, together: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query (vec_id, v), never its own id. k is less than the index's copies."""
    packed = stored(blocks(queries.groupBy("vec_id").agg(F.min("v").alias("v")), block), "queries")
    shards = graphs.groupBy("width").agg((F.max("shard") + 1).alias("shards"))
    packed = packed.join(shards, "width").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))

    def answers(row: dict[str, pa.Scalar]) -> Iterator[pa.RecordBatch]:
        """The hits of one block of queries in one shard, whose arrays are read where they lie."""
        array = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)
        width, own, v = row["width"].as_py(), row["q"].values.field("vec_id").to_numpy(), row["q"].values.field("v")
        queries = v.flatten().to_numpy().reshape(len(own), width)
        x = array("x", np.float64).reshape(-1, width)
        graph = Graph(x, array("links", np.int32).reshape(len(x), -1), array("entry", np.int32))
        offsets, ids = array("offsets", np.int64), array("ids", np.int64)
        for at in range(0, len(own), 256):
            part, q = own[at : at + 256].tolist(), queries[at : at + 256]
            found, _ = graph.search(q, max(beam, k + 1))
            rows: list[tuple] = []
            for query, v, near in zip(part, q, found):
                near = near[near >= 0]
                d = np.sqrt(np.square(x[near] - v).sum(1))
                # k + 1 nodes hold k candidates besides the query's own
                best = np.argsort(d, kind="stable")
                limit = d[best[min(k, len(best) - 1)]]
                mine = [(dist, i) for dist, node in zip(d[d <= limit], near[d <= limit]) for i in ids[offsets[node] : offsets[node + 1]].tolist() if i != query]
                rows += [(query, i, dist) for dist, i in sorted(mine)[:k]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["query_id", "vec_id", "score"])

    def task(index: pa.Table, part: pa.Table) -> pa.Table:
        """The hits of some blocks in one shard, which they share."""
        known = {c: index.column(c)[0] for c in ("x", "links", "entry", "offsets", "ids")} if index.num_rows else {}
        found = [batch for at in range(part.num_rows) if known for batch in answers(known | {"width": part.column("width")[at], "q": part.column("q")[at]})]
        return pa.Table.from_batches(found, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    # a shard's arrays are sent once for `together` blocks of queries, which is what a task holds
    packed = packed.withColumn("part", F.floor(F.col("block") / together))
    to = ["width", "shard", "part"]
    asked = packed.select(*(F.col(c).alias(f"to_{c}") for c in to)).distinct()
    sent = graphs.join(asked, (F.col("width") == F.col("to_width")) & (F.col("shard") == F.col("to_shard"))).drop("width", "shard")
    hits = sent.groupBy(*(f"to_{c}" for c in to)).cogroup(packed.groupBy(*to)).applyInArrow(task, HIT)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
