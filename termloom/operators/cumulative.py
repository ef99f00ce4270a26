"""Prefix sums over data of any size and skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import cut


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows before the row in the order of ``order`` (exclusive).

    The rows are range-partitioned; each range is summed on its own and only one total per range, a few thousand
    numbers, is brought together. No key has to fit one task. Equal keys are told apart by nothing, so ``order``
    should be unique. The result keeps the rows of ``df``, which may be empty.
    """
    ranged = df.withColumn("__value", value.cast("long")).repartitionByRange(*order)
    ranged = cut(ranged.sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id()))
    totals = ranged.groupBy("__part").agg(F.sum("__value").alias("t"))
    before = totals.select("__part", (F.sum("t").over(Window.orderBy("__part")) - F.col("t")).alias("__before"))
    inside = F.sum("__value").over(Window.partitionBy("__part").orderBy("__seq").rowsBetween(Window.unboundedPreceding, -1))
    done = ranged.withColumn("__in", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "__part")
    return done.withColumn(name, F.col("__before") + F.col("__in")).drop("__part", "__seq", "__before", "__in", "__value")
