"""Places of rows in an order, counted over ranges, so that no group's rows meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch


def placed(rows: DataFrame, group: list[str], order: list[str], place: str, total: str, each: int = 100_000) -> DataFrame:
    """rows with their place from 0 in the order among their group's rows, and how many rows the group has.

    rows: a stored table, as it is read three times. group has no nulls; nulls in order come first. Rows that tie are told
    apart by where they are read, so that a range never holds many more than each, even if a third of all rows are equal.
    A place is that in a range and what the group has in the ranges before; counts of ranges are all that one window holds.
    """
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(scratch.files_for(rows.count(), each), *group, *order, "_tie")
    dealt = scratch.stored(dealt.withColumn("_range", F.spark_partition_id()), "placed")
    counts = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_here"))
    by = Window.partitionBy(*group)
    upto = F.sum("_here").over(by.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(*group, "_range", F.coalesce(upto, F.lit(0)).alias("_before"), F.sum("_here").over(by).alias(total))
    within = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order, "_tie")) - 1
    met = dealt.withColumn("_within", within).join(before, [*group, "_range"])
    return met.withColumn(place, F.col("_within") + F.col("_before")).drop("_tie", "_range", "_within", "_before")
