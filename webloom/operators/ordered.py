"""What depends on all that came before, over rows in one global order and without one task for all of them.

Rows are sorted by range; each partition works on its own rows, and what the partitions before it amount to (a row for each of them) is joined to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.tables import kept


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """rows, checkpointed, with part and place: the number of the sort's partition, and a number that grows with the order."""
    placed = kept(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()))
    return placed.withColumn("part", F.shiftright("place", 33))


def before(placed: DataFrame, name: str, value: Column, greatest: bool = False) -> DataFrame:
    """placed (of in_order) with a column `name`: value in the last row before each, or the greatest value of all rows before; null for the first row."""
    rows = placed.withColumn(name, value)
    own = Window.partitionBy("part").orderBy("place")
    edges, at_edge = [], None
    for r in rows.groupBy("part").agg((F.max(name) if greatest else F.max_by(name, "place")).alias("told")).orderBy("part").collect():  # a row for each partition
        edges.append((r["part"], at_edge))
        known = [x for x in (at_edge, r["told"]) if x is not None]
        at_edge = (max(known) if known else None) if greatest else r["told"]
    edge = rows.sparkSession.createDataFrame(edges, StructType([StructField("part", LongType()), StructField("edge", rows.schema[name].dataType)]))
    inner = F.max(name).over(own.rowsBetween(Window.unboundedPreceding, -1)) if greatest else F.lag(name).over(own)
    both = rows.withColumn("inner", inner).join(F.broadcast(edge), "part", "left")
    first = F.row_number().over(own) == 1
    told = F.greatest("inner", "edge") if greatest else F.when(F.col("first"), F.col("edge")).otherwise(F.col("inner"))
    return both.withColumn("first", first).withColumn(name, told).drop("inner", "edge", "first")
