"""Places in a global order, without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pentad.storage import cut


def with_position(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """df and each row's place (from 0). Ranges of the order are sorted side by side; what a range adds to its rows'
    places comes from a table with one row for each range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    laid = cut(laid.withColumn("_range", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    ranges = laid.groupBy("_range").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return laid.join(F.broadcast(ranges), "_range").withColumn(name, F.col("_id") + F.col("_shift")).drop("_range", "_id", "_shift")


def pages(df: DataFrame, order: list[Column], size: int = 5) -> DataFrame:
    """df with page (from 0), size rows on each in this order."""
    return with_position(df, order, "_pos").withColumn("page", F.call_function("div", F.col("_pos"), F.lit(size).cast("bigint"))).drop("_pos")


def with_rank(df: DataFrame, group: str, order: list[Column], name: str = "rank", size: str = "size") -> DataFrame:
    """df with each row's place in its group (from 0) and the group's size, from places in the order of all: no group is
    sorted by one task."""
    laid = with_position(df, [F.col(group), *order], "_at")
    spans = laid.groupBy(F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias(size))
    joined = laid.join(spans, F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_first", "_group")
