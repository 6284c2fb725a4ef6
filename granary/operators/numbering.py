"""Row numbers without one window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.plans.lineage import keep


def numbered(df: DataFrame, order: str | None = None, name: str = "id") -> DataFrame:
    """df with numbers from 0: in the order of a column, or as rows lie in partitions.

    Rows are numbered in their partitions, and partitions by the sizes of those before.
    """
    dealt = df.repartitionByRange(order).sortWithinPartitions(order) if order else df
    held = keep(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    sizes = held.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    # A row for each partition; row ids rise by one in a partition, from its number times 2**33.
    return held.join(F.broadcast(before), "__part").withColumn(name, (F.col("__row") - F.shiftleft(F.col("__part").cast("long"), 33) + F.col("__before"))).drop("__part", "__row", "__before")
