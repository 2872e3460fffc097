"""Consecutive numbers in key order, without gathering the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracell.plans.durable import durable

#: monotonically_increasing_id() puts the partition above this bit, the place in it below.
_PLACE_BITS = 33


def numbered(df: DataFrame, key: str, name: str, first: int = 0) -> DataFrame:
    """``df`` with each row's place by the unique ``key``, from ``first`` on.

    Rows are range-partitioned and numbered within their partition; only one count a
    partition is summed up in one place.
    """
    placed = durable(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", _PLACE_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + F.lit(first)
    # One row a partition: as small as the list of partitions that the driver holds anyway.
    return placed.join(F.broadcast(offsets), "_part").select(*df.columns, place.alias(name))
