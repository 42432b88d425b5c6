"""Tables of a folder of Parquet files."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """An inline table: rows as in SQL VALUES, columns by name."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def kept(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder: rounds must not be computed again by later ones."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        where = context.getConf().get("spark.checkpoint.dir")
        if not where and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="webloom-"))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over three tasks for each core: small rows that much work follows, which splits and shuffles measured in bytes would leave to a few tasks."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)
