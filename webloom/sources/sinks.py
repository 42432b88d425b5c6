"""Where results go: a store addressed by content, reports, audit lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def store_content(pages: DataFrame, folder: str) -> None:
    """Each distinct body of pages (html) once, by its hash, in folders by the hash's first two digits."""
    bodies = pages.select(T.content_hash(F.col("html")).alias("content_hash"), "html").groupBy("content_hash").agg(F.any_value("html").alias("html"))
    shard = F.substring("content_hash", 1, 2).alias("shard")
    bodies.select("content_hash", "html", shard).repartition("shard").write.mode("append").partitionBy("shard").parquet(folder)


def with_content(pages: DataFrame, folder: str) -> DataFrame:
    """pages (content_hash) with the html that the store has; the shard of a hash prunes the store's folders."""
    content = pages.sparkSession.read.parquet(folder)
    return pages.withColumn("shard", F.substring("content_hash", 1, 2)).join(content, ["shard", "content_hash"], "left").drop("shard")


def write_report(report: DataFrame, folder: str) -> None:
    report.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(folder)


def append_audit(events: DataFrame, folder: str) -> None:
    """Audit events as JSON lines; files are only ever added."""
    events.write.mode("append").json(folder)


def read_audit(spark, folder: str, schema: str) -> DataFrame:
    """The audit events, without lines that can't be read."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)
