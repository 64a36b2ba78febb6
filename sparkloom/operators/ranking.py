"""Ranks of a whole table, without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import written


def ranked(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """rows with their place in an order, from 1 on: ranges of the order are counted apart and moved by those before.

    The ranges are written once, as the bounds of a range partitioning may differ between two readings.
    """
    ranges = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_range", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn(name, place.cast("long")).join(F.broadcast(counts), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
