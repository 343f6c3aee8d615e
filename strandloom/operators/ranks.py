"""Numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.plans.session import written


def sums_before(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """`rows` with `name`, the sum of `value` over all rows with a smaller key: sums inside ranges of keys, and of the whole ranges before. Only a number for each range meets in one task; keys are distinct."""
    placed = written(rows.repartitionByRange(key).withColumn("__range", F.spark_partition_id()), "ranges")
    ranges = placed.groupBy("__range").agg(F.sum(value).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    own = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn(name, F.coalesce(F.sum(value).over(own), F.lit(0)))
    return summed.join(ranges, "__range").withColumn(name, (F.col(name) + F.col("__first")).cast("long")).drop("__range", "__first")
