"""Language proportions of documents by a mixture of n-gram models.

Training counts hashed letter trigrams of all labelled training rows for each language: partial counts on the map
side, summed by (language, bucket). The model has languages x buckets numbers, whatever the size of the input.
For each text, expectation-maximisation finds the proportions of languages under which its trigrams are likeliest;
languages enter in the order of their proportions while the log-likelihood gains more than a penalty a language.

A text that is null or has no letter gets `und`, score 0 and no languages. With nothing to learn from, all do. Ties go
to the language that sorts first. Equal rows are predicted once each. A null id is never learned from. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ngrams import Trigrams
from .shared import discard, stored, whole

UNKNOWN = "und"
PREDICTION = "doc_id long, held_out boolean, lang_pred string, score double, languages string"


def count(train: DataFrame, buckets: int) -> DataFrame:
    """(lang, bucket, n) over train (lang, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, totals = Trigrams(buckets, letters_only=True), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                n = grams.counts(text.as_py())
                if lang in totals:
                    totals[lang] += n
                else:
                    totals[lang] = n
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": at.astype(np.int32), "n": n[at]})

    rows = train.select("lang", "text").filter("lang is not null and text is not null")
    return rows.mapInArrow(task, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Mixture:
    """Per-language trigram probabilities; proportions() is the inference for one text."""

    def __init__(self, counts: pa.Table, buckets: int, smooth: float = 0.5, penalty: float = 3.0, rounds: int = 25, nearness: float = 1e-3):
        self.buckets, self.penalty, self.rounds, self.nearness = buckets, penalty, rounds, nearness
        self.names = sorted(counts["lang"].unique().to_pylist())
        c = np.full((len(self.names), buckets), smooth)
        row = np.array([self.names.index(x) for x in counts["lang"].unique().to_pylist()], int)
        at = counts["lang"].combine_chunks().dictionary_encode() if counts.num_rows else None
        if at is not None:
            c[row[at.indices.to_numpy()], counts["bucket"].to_numpy()] += counts["n"].to_numpy()
        self.p = c / c.sum(1, keepdims=True) if self.names else c
        self.left_out = 0

    def _fit(self, p: np.ndarray, n: np.ndarray, total: float) -> tuple[np.ndarray, float]:
        mix = np.full(len(p), 1 / len(p))
        for _ in range(self.rounds):
            new = mix * (p @ (n / (mix @ p))) / total
            done = np.abs(new - mix).max() < self.nearness
            mix = new
            if done:
                break
        return mix, float(n @ np.log(mix @ p))

    def proportions(self, counts: np.ndarray) -> dict[str, float]:
        """The share of each language of the set that the penalised likelihood selects."""
        return self.inferred(counts)[0]

    def inferred(self, counts: np.ndarray) -> tuple[dict[str, float], dict[str, float]]:
        """proportions(), and the shares of all languages where none is left out, which tell how sure the choice is."""
        at = np.flatnonzero(counts)
        n, p = counts[at].astype(float), self.p[:, at]
        total = n.sum()
        single = np.log(p) @ n
        best = int(single.argmax())
        chosen, mix, fit, full = [best], np.ones(1), float(single[best]), np.ones(1)
        if len(self.names) > 1:
            full, most = self._fit(p, n, total)
            price = self.penalty * np.log(total + 1)
            if most - fit > price:
                order = sorted((i for i in range(len(self.names)) if i != best), key=lambda i: (-full[i], i))
                for i in order:
                    wider, gain = self._fit(p[[*chosen, i]], n, total)
                    if gain - fit <= price:
                        break
                    chosen, mix, fit = [*chosen, i], wider, gain
        return {self.names[i]: float(m) for i, m in zip(chosen, mix)}, dict(zip(self.names, full.tolist()))


def fit(train: DataFrame, buckets: int = 1 << 15, most_languages: int = 512) -> Mixture:
    """Reads all of train (lang, text). The model is one table of languages x buckets numbers, which the driver and every
    task hold: 128 MB at the most languages it is made for. Where labels are more, those with the most trigrams are learned, ties to the label
    that sorts first, and left_out tells how many are not.
    """
    counts = stored(count(train, buckets), "trigrams")
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    few = stored(sizes.orderBy(F.desc("n"), "lang").limit(most_languages), "labels")
    left_out = sizes.count() - few.count()
    learned = counts.join(F.broadcast(few.select("lang")), "lang") if left_out else counts  # at most most_languages rows
    model = Mixture(learned.select("lang", "bucket", "n").toArrow(), buckets)
    model.left_out = left_out
    for df in (counts, few):
        discard(df)
    return model


def predict(docs: DataFrame, model: Mixture, keep: list[str] = ()) -> DataFrame:
    """docs (doc_id, held_out, text) to PREDICTION and what keep names. languages: name:share of the selected set, largest
    first; score: the share that the first of them has where every language may take part."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets numbers
    names = [x.split()[0] for x in PREDICTION.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        grams = Trigrams(model.buckets, letters_only=True)
        for batch in batches:
            found: list[tuple[str, float, str]] = []
            for text in batch.column("text"):
                text = text.as_py()
                shares, full = {}, {}
                if text and model.names and any(map(str.isalpha, text)):
                    shares, full = model.inferred(grams.counts(text))
                ranked = sorted(shares.items(), key=lambda x: (-x[1], x[0])) or [(UNKNOWN, 0.0)]
                first = ranked[0][0]
                found.append((first, full.get(first, 0.0), ",".join(f"{k}:{v:.4f}" for k, v in ranked) if shares else ""))
            pred, score, langs = zip(*found) if found else ((), (), ())
            own = [batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array(langs, pa.string())]
            yield pa.RecordBatch.from_arrays(own + [batch.column(c) for c in keep], names + list(keep))

    rows = docs.select("doc_id", "held_out", "text", *keep)
    schema = T._parse_datatype_string(PREDICTION)
    for c in keep:
        schema = schema.add(rows.schema[c])
    return rows.mapInArrow(task, schema)


def identified(docs: DataFrame, model: Mixture) -> DataFrame:
    """The rows of docs (doc_id, text, lang and others) whose language the model tells; a null lang becomes the prediction."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("held_out"), "text", whole(docs))
    told = predict(rows, model, keep=["row"]).filter(F.col("lang_pred") != UNKNOWN)
    return told.select(*(F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
