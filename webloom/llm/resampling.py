"""Importance resampling of documents towards a target corpus by bucketed word features.

A pre-tokeniser (an untrained Split by a regular expression) tells the words of an ASCII-lowered text by their offsets; each pair of offsets
that spans 1 to `longest` consecutive words is a feature, hashed by CRC into a bucket. Bucket counts of all documents and of all target
texts give each bucket a gain, a document's weight is the mean gain of its features, and Gumbel noise from its id turns the highest
weights into a sample without replacement.

The features of a document are kept as (bucket, count) pairs in a stored table, so texts are cut once. Each task sums its
documents' histogram before a shuffle. Scores are whole numbers within a fixed range, so the score from which documents are drawn
comes from counts by score; only the drawn ones are sorted, by range, and ranked by their place.

A null text has no words and so no features; its weight is 0. A null doc_id has the noise of an empty id and stays null. Equal rows are documents
of their own; where equal ids tie, which of them is drawn is open, and their rows are equal but for the rank. Texts of any length are taken whole.
Empty documents give no rows; an empty target leaves the gains to the source alone. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from .shared import stored

#: Fixed values of the contract: what parts words, the noise's seed, what is added to a count and to all of them.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEED = "2024"
_PIECE = 1 << 14
_KNOWN = 1 << 20


class Features:
    """The buckets of a text's features."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest = buckets, longest
        self.split = pre_tokenizers.Split(Regex(SEPARATORS), "removed")
        self.known: dict[str, int] = {}

    def words(self, text: str) -> Iterator[str]:
        """Words of an ASCII-lowered text; a long one is cut between words, since offsets cost more in long texts."""
        at = 0
        while at < len(text):
            end = at + _PIECE
            while end < len(text) and (text[end] > "\x7f" or text[end].isalnum()):
                end += 1
            for word, _ in self.split.pre_tokenize_str(text[at:end]):
                yield word
            at = end

    def _bucket(self, feature: str) -> int:
        if len(self.known) >= _KNOWN:
            self.known.clear()
        self.known[feature] = b = zlib.crc32(feature.encode()) % self.buckets
        return b

    def of(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
        """(number of words, distinct buckets, their counts)."""
        words = list(self.words((text or "").encode().lower().decode()))
        known, bucket = self.known, self._bucket
        spans = ((i, i + n) for n in range(2, self.longest + 1) for i in range(len(words) - n + 1))
        runs = chain(words, (" ".join(words[i:j]) for i, j in spans))
        found = np.array([known[f] if f in known else bucket(f) for f in runs], np.int32)
        return len(words), *np.unique(found, return_counts=True)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(parts or [np.zeros(0)]).astype(np.int32)))


def features(docs: DataFrame, buckets: int = 10_000, longest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored rows (doc_id, n_words, n_features, buckets, counts) of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features(buckets, longest).of
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [of(t.as_py()) for t in part.column("text")]
                counts = [c for *_, c in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([n for n, *_ in found], pa.int64()), pa.array([int(c.sum()) for c in counts], pa.int64()), _lists([b for _, b, _ in found]), _lists(counts)],
                    ["doc_id", "n_words", "n_features", "buckets", "counts"],
                )

    return stored(rows.mapInArrow(cut, f"doc_id {kind}, n_words long, n_features long, buckets array<int>, counts array<int>"), "features")


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def histogram(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in what features() found: one histogram a task, summed by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, _flat(batch.column("buckets")), _flat(batch.column("counts")))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in found.select("buckets", "counts").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight, in thousandths."""
    n, m, buckets = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(((t + 1) * (n + buckets)) / ((s + 1) * (m + buckets)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain; 0 without features."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.concatenate([[0], np.cumsum(gain[_flat(batch.column("buckets"))] * _flat(batch.column("counts")))])
            ends = np.concatenate([[0], np.cumsum(batch.column("buckets").value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            n = batch.column("n_features").to_numpy()
            weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def scored(rows: DataFrame) -> DataFrame:
    """rows with score: the weight and Gumbel noise that only the id tells."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    chance = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return rows.withColumn("score", F.col("weight") + F.floor(F.lit(-1000) * F.log(-F.log(chance))))


def drawn(rows: DataFrame, percent: int, least_words: int) -> DataFrame:
    """rows (doc_id, n_words, ..., score), stored, with rank: 1, 2, 3... for the best percent of those of least_words and more, by score and then by id; else null."""
    enough = F.col("n_words") >= least_words
    by_score = rows.filter(enough).groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("score")).collect()
    wanted = percent * sum(r["n"] for r in by_score) // 100
    seen, edge = 0, None
    for r in by_score:
        if seen < wanted:
            seen, edge = seen + r["n"], r["score"]
    none = F.lit(None).cast("long").alias("rank")
    if edge is None:
        return rows.select("*", none)
    in_reach = enough & (F.col("score") >= edge)
    best = stored(rows.filter(in_reach).orderBy(F.desc("score"), "doc_id").withColumn("place", F.monotonically_increasing_id()), "drawn")
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for r in best.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["n"]
    table = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part long, before long"))  # a row for each partition
    ranked = best.withColumn("part", part).join(table, "part").withColumn("rank", F.col("before") + row + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return rows.filter(~in_reach).select("*", none).unionByName(ranked.select(*rows.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of docs (doc_id, text), drawn towards target (text)."""
    found = features(docs, buckets, longest)
    goal = features(target.select(F.lit(0).alias("doc_id"), "text"), buckets, longest)
    gain = gains(histogram(found, buckets), histogram(goal, buckets))
    return drawn(stored(scored(weighted(found, gain)), "scores"), percent, least_words)
