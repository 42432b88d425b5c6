"""Near duplicates by ProbMinHash: signatures of weighted word shingles, banding, verification, classes.

A shingle is five consecutive words, its weight how often it occurs; a shorter text is one shingle. Every shingle sends
arrivals of a Poisson process of its weight to random registers and each register keeps the shingle that came first, so two
texts agree in a register with the probability Jaccard similarity of their weighted shingles. A shingle stops once its
next arrival is later than every register's. Registers are banded; texts that share a band are candidates.

Equal texts are one vertex, keyed by a hash, before anything is paired. In a bucket each text is first compared with one leader
only, the text that shares most buckets with others, and what is linked so far falls into components. Texts of a bucket that are
then still outside its leader's component are compared with every text there of another component that can be similar, so any two
similar texts that share a bucket end in one class, without all pairs of a group. In large buckets, where texts of one
origin with many edits abound, a bound decides who can be: a shingle that at most `rare` texts have brings those
together by itself, and texts a, b that share no such shingle have a Jaccard similarity of at most
min(|a| - r(a), |b| - r(b)) / max(|a| + r(b), |b| + r(a)), where r counts a text's rare shingles. With weights, x being the
share of a's weight on rare shingles and y that of b's, their probability Jaccard is at most PQ / max(Q + yP, P + xQ), where
P = 1 - x and Q = 1 - y: each common shingle adds at most 1 / (1 / p + y / q), which is concave, so the sums bound it. Links need
an exact probability Jaccard of at least the threshold.

Texts that are null or have no word are in classes of their own, one a row. The class is the smallest doc_id in it (null only
if all its ids are). Repeated rows share a class. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored, whole

_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output looks random (splitmix64)."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Distinct shingle hashes of a text, ascending, and their weights. Hashes of words are kept, at most `most` of them."""

    def __init__(self, size: int = 5, most: int = 400_000):
        self.size, self.most, self.kept = size, most, {}
        self.odd = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = _words(text or "")
        if not words:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(self.kept) > self.most:
            self.kept.clear()
        hashes = list(map(self.kept.get, words))
        if None in hashes:
            for i, h in enumerate(hashes):
                if h is None:
                    hashes[i] = self.kept[words[i]] = hashlib.blake2b(words[i].encode("utf-8", "surrogatepass"), digest_size=8).digest()
        h = np.frombuffer(b"".join(hashes), "<u8")
        n = max(1, len(h) - self.size + 1)
        s = np.zeros(n, np.uint64)
        for k in range(min(self.size, len(h))):
            s += h[k : k + n] * self.odd[k]
        return np.unique(mix(s), return_counts=True)


def signatures(texts: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """ProbMinHash of each of texts (shingles, weights), all with a shingle; (texts, registers) of shingle hashes."""
    h = np.concatenate([t[0] for t in texts])
    w = np.concatenate([t[1] for t in texts]).astype(float)
    d = np.repeat(np.arange(len(texts)), [len(t[0]) for t in texts])
    first = np.full((len(texts), registers), np.inf)
    which = np.zeros(len(texts) * registers, np.uint64)
    flat = first.ravel()
    latest = np.full(len(texts), np.inf)
    time = np.zeros(len(h))
    turn = 0
    while len(h):
        turn += 1
        r = mix(h + np.uint64(turn * 0xD1342543DE82EF95 % 2**64))
        # 53 bits for the time, what a second mixing gives for the register
        time = time - np.log1p(-(r >> np.uint64(11)).astype(float) * 2.0**-53) / w
        on = time < latest[d]
        h, w, d, time, r = h[on], w[on], d[on], time[on], r[on]
        if not len(h):
            break
        at = d * registers + (mix(r) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(flat, at, time)
        won = flat[at] == time
        which[at[won]] = h[won]
        changed = np.unique(d) if len(d) < len(texts) else slice(None)
        latest[changed] = first[changed].max(1)
    return which.reshape(len(texts), registers)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.reshape(len(signature), bands, -1)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), rows.shape[:2])
    for k in range(rows.shape[2]):
        key = mix(key ^ rows[:, :, k])
    return key.astype(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two texts (shingles, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if a[1].max() == 1 and b[1].max() == 1:
        return len(both) / (len(a[0]) + len(b[0]) - len(both))
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    # sum over d' of max(a(d') / a(d), b(d') / b(d)): those d' whose a/b is at least d's count with a, the others with b
    order = np.argsort(x / y, kind="stable")
    ratio = (x / y)[order]
    below = np.searchsorted(ratio, ratio, "left")
    sum_x, sum_y = np.concatenate([[0], np.cumsum(x[order])]), np.concatenate([[0], np.cumsum(y[order])])
    union = (sum_x[-1] - sum_x[below] + only_a) / x[order] + (sum_y[below] + only_b) / y[order]
    return float((1 / union).sum())


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """docs (doc_id, key, text) to (doc_id, key, bands); bands: null where there is no word."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [shingles(t.as_py()) for t in part.column("text")]
                keys: list[list[int] | None] = [None] * len(texts)
                some = [i for i, t in enumerate(texts) if len(t[0])]
                if some:
                    for i, k in zip(some, band_keys(signatures([texts[i] for i in some], bands * rows), bands)):
                        keys[i] = k
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "key", "bands"])

    return docs.select("doc_id", "key", "text").mapInArrow(task, "doc_id long, key binary, bands array<long>")


def shingled(vertices: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, h, w, plain) of vertices (key, rep), one row each, stored; plain: all weights are 1, then w is empty."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column("text")]
            plain = [bool(w.max(initial=1) == 1) for _, w in found]
            weights = [w[:0] if p else w for (_, w), p in zip(found, plain)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.int64())), pa.array(plain)], ["key", "h", "w", "plain"])

    named = vertices.select(F.col("key").alias("k"), "rep")
    texts = docs.join(named, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("key", "text")
    return stored(texts.mapInArrow(task, "key binary, h array<long>, w array<long>, plain boolean").dropDuplicates(["key"]), "near-shingles")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) of keys, those that are similar; stored."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(h: pa.Scalar, w: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
            h, w = h.values.to_numpy().view(np.uint64), w.values.to_numpy()
            return h, w if len(w) else np.ones(len(h), np.int64)

        for batch in batches:
            ah, aw, bh, bw = (batch.column(c) for c in ("ah", "aw", "bh", "bw"))
            near = [similarity(read(ah[i], aw[i]), read(bh[i], bw[i])) >= threshold for i in range(batch.num_rows)]
            mask = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    side = lambda x: sets.select(F.col("key").alias(x), F.col("h").alias(f"{x}h"), F.col("w").alias(f"{x}w"))
    return stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(task, "a binary, b binary"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """(key, component) of every key in links (a, b); a component is its least key. Labels go to neighbours and to the labels' own labels until none changes."""
    arcs = stored(links.union(links.select("b", "a")).distinct().toDF("a", "b"), "near-arcs")
    labels = stored(arcs.groupBy(F.col("a").alias("key")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "near-labels")
    before = labels
    while True:
        near = arcs.join(labels.withColumnRenamed("key", "a"), "a").groupBy(F.col("b").alias("key")).agg(F.min("component").alias("new"))
        wide = labels.join(near, "key", "left").select("key", "component", F.least("component", "new").alias("new"))
        wide = stored(wide, "near-labels")
        own = wide.select(F.col("key").alias("new"), F.col("new").alias("newer"))
        nearer = stored(wide.join(own, "new", "left").select("key", "component", F.least("new", "newer").alias("new")), "near-labels")
        discard(wide)
        discard(before)
        before, labels = nearer, nearer.select("key", F.col("new").alias("component"))
        if nearer.filter("component != new").isEmpty():
            discard(arcs)
            return labels


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def remaining(labelled: DataFrame, sets: DataFrame, threshold: float, large: int, rare: int, salt: int = 2048) -> DataFrame:
    """Pairs (a, b) of labelled (band, key, n, c, lead) that may link what is outside a bucket's leader's component to the rest of the bucket.

    Buckets of at most `large` texts give all such pairs. In larger ones a pair comes up in the first band that both share,
    if the bound allows it, or by a rare shingle.
    """
    outside = F.col("c") != F.col("lead")
    rest = stored(labelled.filter(outside).select("band", F.col("key").alias("k"), F.col("c").alias("kc"), "n"), "near-rest")
    small = rest.filter(F.col("n") <= large).drop("n").join(labelled.filter(F.col("n") <= large).select("band", "key", "c"), "band").filter("kc != c")
    small = _ordered(small, "k", "key")
    big = rest.filter(F.col("n") > large)
    if big.isEmpty():
        return small
    members = stored(labelled.select("band", "key", "c").join(big.select("band").distinct(), "band", "left_semi"), "near-large")
    per_key = members.groupBy("key").agg(F.any_value("c").alias("c"), F.sort_array(F.collect_list("band")).alias("own"))  # at most all bands of a text
    total = F.when(F.col("plain"), F.size("h")).otherwise(F.aggregate("w", F.lit(0).cast("long"), lambda a, b: a + b))
    held = stored(sets.join(per_key.select("key", "c"), "key").select("key", "c", "plain", F.size("h").alias("size"), total.alias("total"), "h", "w"), "near-held")
    spread = held.select("key", "c", F.explode(F.arrays_zip("h", "w")).alias("x")).select("key", "c", F.col("x.h").alias("s"), F.coalesce("x.w", F.lit(1)).alias("w"))
    few = stored(spread.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.min("w").alias("w")).filter(F.col("n") <= rare), "near-rare")
    # a shingle of one text names that text itself; only those of several are looked up
    scarce = stored(spread.join(few.filter("n > 1").select("s"), "s"), "near-scarce")
    other = scarce.select("s", F.col("key").alias("k"), F.col("c").alias("kc"))
    by_rare = _ordered(scarce.select("s", "key", "c").join(other, "s").filter("k < key and kc != c"), "k", "key")  # at most rare ** 2 / 2 a shingle
    rares = few.filter("n = 1").select("key", "w").union(scarce.select("key", "w")).groupBy("key").agg(F.count(F.lit(1)).alias("r"), F.sum("w").alias("rw"))
    counted = held.select("key", "plain", "size", "total").join(rares, "key", "left").join(per_key.select("key", "own"), "key")
    counted = stored(counted.select("key", "plain", "size", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce(F.col("rw") / F.col("total"), F.lit(0.0)).alias("part"), "own"), "near-counted")
    x = stored(big.select("band", F.col("k").alias("key"), F.col("kc").alias("c")).join(counted, "key"), "near-outside").select("band", *(F.col(c).alias(f"x_{c}") for c in ("key", "c", "plain", "size", "r", "part", "own")))
    y = stored(members.join(counted, "key"), "near-inside")
    p, q = 1 - F.col("part"), 1 - F.col("x_part")
    able = (p * q >= (threshold - 1e-9) * F.greatest(q + F.col("x_part") * p, p + F.col("part") * q)) & (~(F.col("x_plain") & F.col("plain")) | (F.least(F.col("size") - F.col("r"), F.col("x_size") - F.col("x_r")) >= threshold * F.greatest(F.col("size") + F.col("x_r"), F.col("x_size") + F.col("r")) - 1e-6))
    # a large band's members are dealt to salts of some thousands, and those outside are copied to each salt: no task gets a whole band's pairs
    n_salts = members.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / salt).cast("int").alias("salts"))
    y = y.join(n_salts, "band").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int"))
    x = x.join(n_salts, "band").withColumn("x_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    by_bound = _ordered(y.join(x, (y["band"] == x["band"]) & (F.col("salt") == F.col("x_salt")) & (F.col("c") != F.col("x_c")) & able & (F.array_min(F.array_intersect("own", "x_own")) == y["band"])).select("key", "x_key"), "key", "x_key")
    return small.union(by_rare).union(by_bound).distinct()


def classes(docs: DataFrame, threshold: float = 0.8, bands: int = 32, rows: int = 5, large: int = 16, rare: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, class_id, component) of every row, stored; key is a hash of the text, component the least of a class (null without words). large and rare only divide the work, see remaining()."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    sketched = stored(sketches(docs, bands, rows), "near-sketches")
    # one vertex per text; a group of copies is combined before it is shuffled
    vertices = stored(sketched.filter("bands is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.count(F.lit(1)).alias("copies")), "near-vertices")
    members = vertices.select("key", F.explode("bands").alias("band"))
    crowds = stored(members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-crowds")
    shared = stored(members.join(crowds, "band"), "near-shared")
    central = stored(shared.groupBy("key").agg(F.sum("n").alias("central")), "near-central")
    leaders = shared.join(central, "key").groupBy("band").agg(F.max(F.struct("central", "key")).alias("x")).select("band", F.col("x.key").alias("leader"))
    shared = stored(shared.join(stored(leaders, "near-leaders"), "band"), "near-members")
    sets = shingled(vertices.join(central, "key", "left_semi").select("key", "rep"), docs)
    pairs = stored(_ordered(shared.filter("key != leader"), "key", "leader"), "near-pairs")
    links = verified(pairs, sets, threshold)
    found = components(links)
    of = lambda c, to: found.select(F.col("key").alias(c), F.col("component").alias(to))
    labelled = shared.join(of("key", "c"), "key", "left").join(of("leader", "lead"), "leader", "left")
    labelled = stored(labelled.select("band", "key", "n", F.coalesce("c", "key").alias("c"), F.coalesce("lead", "leader").alias("lead")), "near-labelled")
    more = stored(remaining(labelled, sets, threshold, large, rare).join(pairs, ["a", "b"], "left_anti"), "near-pairs")
    if not more.isEmpty():
        found = components(links.union(verified(more, sets, threshold)))
    merged = vertices.select("key", "rep", "copies").join(found, "key", "left").select("key", "rep", "copies", F.coalesce("component", "key").alias("component"))
    least = stored(merged.groupBy("component").agg(F.min("rep").alias("class_id")), "near-classes")
    named = stored(merged.join(least, "component").select("key", "copies", "class_id", "component"), "near-classes")
    # a text that more than a thousandth of all rows repeat is looked up in a table of at most a thousand rows, so its copies don't meet in one task
    n = sketched.count()
    often = F.broadcast(named.filter(F.col("copies") * 1000 > n).select("key", F.col("class_id").alias("often_id"), F.col("component").alias("often")))
    looked = sketched.filter("bands is not null").select("doc_id", "key").join(often, "key", "left")
    rarer = looked.filter("often is null").select("doc_id", "key").join(named, "key").select("doc_id", "key", "class_id", "component")
    worded = rarer.union(looked.filter("often is not null").select("doc_id", "key", F.col("often_id").alias("class_id"), F.col("often").alias("component")))
    return stored(worded.union(sketched.filter("bands is null").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(None).cast("binary").alias("component"))), "near-result")


def representatives(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs (doc_id, text and others), one of each class: that with the least id, null last, and key of its text; and rows without words all."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("x")
    chosen = classes(docs, **settings).filter("component is not null").groupBy("component").agg(least).select("component", F.col("x.doc_id").alias("id"), F.col("x.key").alias("key"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    worded = text.rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(whole(docs), F.col("doc_id").cast("long").alias("i"), text_key(text).alias("k"), worded.alias("worded"))
    kept = rows.filter("worded").join(stored(chosen, "near-kept"), (F.col("k") == F.col("key")) & F.col("i").eqNullSafe(F.col("id"))).dropDuplicates(["component"])
    return kept.select("row.*").unionByName(rows.filter("not worded").select("row.*"))
