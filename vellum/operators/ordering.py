"""Numbers of rows in a total order, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.sources.durable import store


def numbered(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """``rows`` with their place (from 1): ranges are sorted apart, and each is offset by
    the sizes of those before it, of which there are as many as partitions."""
    part, nth = f"_{name}_part", f"_{name}_nth"
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_ = store(ranged.select("*", F.spark_partition_id().alias(part), within.alias(nth)), "ordered")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sorted_.groupBy(part).agg(F.count("*").alias("n")).select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return sorted_.join(sizes, part).withColumn(name, F.col(nth) + F.col("before") + 1).drop(part, nth, "before")
