"""What the operators of this subpackage share: tables, the shared folder, splits by id."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and the master is local, as in tests, a temporary folder that goes with the process."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("webloom.shared.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
        folder = tempfile.mkdtemp(prefix="webloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        where = f"file://{folder}"
        spark.conf.set("webloom.shared.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again. Cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes what stored() wrote for df, once nothing that still has to run reads it. Other DataFrames stay as they are."""
    if path := getattr(df, "stored_at", None):
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def id_remainder(col: str, modulus: int) -> Column:
    """crc32(id as text) mod modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % F.lit(modulus)


def whole(df: DataFrame) -> Column:
    """All columns of df as one struct named row, so that other columns beside it can't clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: a lambda binds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op: Callable[[Column, Column], Column] = lambda a, b: a + b, block: int = 256) -> Column:
    """The running sums (or what op tells, from 0 on) of an array of ints. Blocks are summed by themselves and then moved, so that
    long arrays don't cost the square of their length."""

    def plain(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, start, lambda s, v: let(op(s["at"], v), lambda n: F.struct(n.alias("at"), F.concat(s["out"], F.array(n)).alias("out"))), lambda s: s["out"])

    def moved(sums: Column) -> Column:
        before = let(F.transform(sums, lambda x: F.element_at(x, -1)), plain)
        return let(before, lambda b: F.flatten(F.transform(sums, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda v: op(F.get(b, i - 1), v))))))

    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: F.slice(v, b * block + 1, F.lit(block)))
    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).when(F.size(v) <= block, plain(v)).otherwise(let(F.transform(blocks(v), plain), moved)))
