"""The queries of this subpackage, one per operator, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention, credentials, graphs, language, mixing, near, packing, pairwise, postings, repair, resampling, sql, warc, weak
from .shared import id_remainder, read, shared_dir, stored


def op1_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    queries = graphs.usable(vectors, "vec_id", "embedding").filter("vec_id % 100 = 0")
    return graphs.search(graphs.index(vectors), queries, beam=192)


def op2_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = pairwise.train(docs.filter(id_remainder("doc_id", 5) != 0), labels)
    scored = pairwise.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = stored(weak.base(read(spark, sf_dir, "documents")), "rules")
    judged = weak.judge(features, weak.rules())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(warc.mark_revisits(read(spark, sf_dir, "pages")), f"{shared_dir(spark)}/warc")
    return warc.scan(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", (id_remainder("doc_id", 5) == 0).alias("held_out"))
    model = language.fit(docs.filter("not held_out"))
    return language.predict(docs, model).withColumn("labels_left_out", F.lit(model.left_out).cast("long"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), targets={"lang": {"en": 0.4}})


def op9_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.secrets(read(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == credentials.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, ("assign", "access", "hex")), F.sha2(credentials.written(F.col("base")), 256).alias("base_sha256"), credentials.written(F.concat("base", "more")).alias("spans"))


def op10_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (id_remainder("doc_id", 7) != 2).alias("learned"))
    scored = attention.score(docs, "learned", public_tokenizers.path("word_bpe_49k.json"))
    return scored.withColumn("held_out", ~F.col("learned")).drop("learned")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(read(spark, sf_dir, "conversations"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = postings.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_pruned_graph, op2_pairwise_quality, op3_probminhash, op4_weak_supervision, op5_warc, op6_harmonic_packing, op7_language_mixture, op8_mixing, op9_credentials, op10_attention, op11_repair, op12_resampling, op13_inverted_index]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op12_resampling": sql.RESAMPLING, "op13_inverted_index": sql.CONTAMINATION}
