"""Windows over a long order without one task for all of a group: ranges of the order, windows within each, and a row a range to carry over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hypotree.sources.sinks import checkpointed


def in_ranges(df: DataFrame, group: str, *order: Column | str) -> DataFrame:
    """df, written in ranges of (group, order), with its range as `part`, which ascends with the order; a large group lies in many."""
    return checkpointed(df.repartitionByRange(group, *order).withColumn("part", F.spark_partition_id()))


def with_earlier(rows: DataFrame, group: str, **totals: tuple[Column, str]) -> DataFrame:
    """rows of in_ranges() with, by name, an aggregate over the earlier ranges of the group, from (aggregate of a range, 'sum', 'max' or 'last' to carry it with).

    Of a group and a range one row is left to meet in a window.
    """
    per = rows.groupBy(group, "part").agg(*[column.alias(name) for name, (column, _) in totals.items()])
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = {"sum": F.sum, "max": F.max, "last": F.last}
    carried = per.select(group, "part", *[carry[how](name).over(earlier).alias(name) for name, (_, how) in totals.items()])
    return rows.join(carried.withColumnRenamed(group, "_group").withColumnRenamed("part", "_part"), F.col(group).eqNullSafe(F.col("_group")) & (F.col("part") == F.col("_part"))).drop("_group", "_part")


def within(group: str) -> Window:
    """The window of one range of a group."""
    return Window.partitionBy(group, "part")
