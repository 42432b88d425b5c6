"""Quality scores from preference pairs: a Bradley-Terry model on text features, cut at a score quantile.

The probability that document a is better than document b is logistic(w . (x_a - x_b)); w minimises the logistic loss
over pairs of a good and a bad labelled document. Features are computed in Spark tasks from whole texts: shares of
hashed character trigrams and a few surface statistics. Pairs come from at most `most` labelled documents (those with
the smallest hashes of their ids), the only bounded sample here; scoring covers every row.

The cut is the quantile of the labelled documents' scores with the best balanced accuracy. Scores are mapped to
0..1 by a logistic curve that puts the cut at `level`, so that score >= level is the threshold by quantile.

A null text counts as empty; an empty text has all features zero and is scored as such. Conflicting labels of one id count as
their mean, 1 from a half up. With no labels, or labels of one class only, w is zero and every score is 0.5. An
empty table gives no rows. Equal rows are scored once each. Of different texts of one labelled id, that with the least MD5 is
learned from. Words are divided by ASCII blanks alone, so a text of other white space has words. Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import Trigrams

BUCKETS = 256
_words = re.compile(r"[^\x20\x09-\x0D]+").findall
SURFACE = 12
#: What stands between words, and nothing else does.
_BLANKS = "\t\n\x0b\x0c\r "


def surface(text: str) -> list[float]:
    """Statistics of a text that do not depend on its language."""
    n = len(text)
    words = _words(text)
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    if not words:
        return [0.0] * SURFACE
    k = len(words)
    return [
        np.log1p(k), len("".join(words)) / k, len(set(words)) / k,
        sum(map(text.count, "#*$%&|<>")) / n, sum(map(text.count, "0123456789")) / n, sum(map(text.count, ".,;:!?")) / n, sum(map(text.count, "|{}[]=_/\\")) / k,
        sum(map(str.isupper, text)) / n, 1 - len(set(lines)) / len(lines), k / len(lines) / 100, sum(len(w) == 1 for w in words) / k, sum(len(w) > 20 for w in words) / k,
    ]


class Features:
    def __init__(self):
        self.grams = Trigrams(BUCKETS, letters_only=False)

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        n = self.grams.counts(text) if text else np.zeros(BUCKETS)
        return np.concatenate([np.sqrt(n / max(1, n.sum())), surface(text)])


@dataclass
class Preference:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    cut: float
    slope: float
    quantile: float
    level: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + (np.log(self.level / (1 - self.level)) if self.w.any() else 0.0)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _descend(x: np.ndarray, good: np.ndarray, bad: np.ndarray, rounds: int = 400, batch: int = 2048, rate: float = 0.05, ridge: float = 1e-3) -> np.ndarray:
    """w of least logistic loss over random pairs (AdaGrad)."""
    rng = np.random.default_rng(7)
    w, seen = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(rounds):
        d = x[rng.choice(good, batch)] - x[rng.choice(bad, batch)]
        g = -(1 / (1 + np.exp(np.clip(d @ w, -50, 50)))) @ d / batch + ridge * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def _cut(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The quantile of s with the best balanced accuracy of s >= it, and the score between its neighbours."""
    order = np.argsort(s, kind="stable")
    good = np.cumsum(y[order])
    bad = np.cumsum(1 - y[order])
    balanced = (1 - good / good[-1] + bad / bad[-1])[:-1]
    balanced[s[order][1:] == s[order][:-1]] = -1  # equal scores are not divided
    if not len(balanced) or balanced.max() < 0:
        return 0.0, float(s[order][0])
    best = np.flatnonzero(balanced >= balanced.max() - 1e-12)
    k = int(best[len(best) // 2])
    return (k + 1) / len(s), float(s[order][k] + s[order][k + 1]) / 2


def _slope(z: np.ndarray, y: np.ndarray) -> float:
    """Slope of a logistic curve through the cut (Newton's method on one ridged parameter)."""
    a = 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z, -50, 50)))
        a = min(50.0, max(1e-3, a - (z @ (p - y) + 1e-2 * a) / (z * z @ (p * (1 - p)) + 1e-2)))
    return a


def fit(x: np.ndarray, y: np.ndarray, level: float = 0.3) -> Preference:
    """x: features of the labelled documents, y: 0 or 1."""
    width = BUCKETS + SURFACE
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Preference(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0, 0.0, level)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    w = _descend(z, good, bad)
    s = z @ w
    quantile, cut = _cut(s, y)
    return Preference(mean, scale, w, cut, _slope(s - cut, y), quantile, level)


def labelled(docs: DataFrame, labels: DataFrame, most: int = 8192, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(y, x) of at most `most` labelled documents: those with the smallest hashes of their ids."""
    chosen = (
        labels.select(F.col(id_col).alias("k"), F.col(label_col).alias("y")).filter("k is not null and y in (0, 1)").groupBy("k").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("k"), "k").limit(most)
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            x = [features(t.as_py()).astype("<f4").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.binary())], ["y", "x"])

    rows = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "k")  # at most `most` rows of two numbers
    one = rows.groupBy("k").agg(F.min_by(F.struct("y", "text"), F.md5("text")).alias("x"))
    return one.select("x.y", "x.text").mapInArrow(task, "y int, x binary")


def train(docs: DataFrame, labels: DataFrame, level: float = 0.3, most: int = 8192) -> Preference:
    rows = labelled(docs, labels, most).orderBy("x", "y").collect()
    x = np.array([np.frombuffer(r.x, "<f4") for r in rows], float).reshape(len(rows), BUCKETS + SURFACE)
    return fit(x, np.array([r.y for r in rows], int), level)


def score(docs: DataFrame, model: Preference, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), shared.value
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(batch.num_rows, BUCKETS + SURFACE)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= model.level).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(task, "doc_id long, score double, predicted int")
