"""Splits, representatives and ranked choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratified(samples: DataFrame, seed: int = 42, test: float = 0.1, validation: float = 0.1) -> DataFrame:
    """Adds split to (class, source): sources of a class stay together.

    Per class at least one source goes to test and to validation (half to even). A
    source with two classes, or a class with fewer than three sources, is an error."""
    sources = samples.groupBy("source").agg(F.min("class").alias("class"), F.countDistinct("class").alias("n"))
    checked = sources.withColumn("class", F.when(F.col("n") == 1, F.col("class")).otherwise(F.raise_error(F.concat(F.lit("a source with two labels: "), F.col("source").cast("string"))).cast(samples.schema["class"].dataType)))
    of = Window.partitionBy("class")
    ranked = checked.withColumns({"size": F.count("*").over(of), "k": F.row_number().over(of.orderBy(F.xxhash64("source", F.lit(seed)), "source"))})
    count = lambda share: F.greatest(F.lit(1), F.bround(F.col("size") * share).cast("int"))
    few = F.raise_error(F.concat(F.lit("a class with too few sources: "), F.col("class").cast("string"))).cast("string")
    split = F.when(F.col("size") < 3, few).when(F.col("k") <= count(test), "test").when(F.col("k") <= count(test) + count(validation), "validation").otherwise("train")
    return samples.join(ranked.select("source", split.alias("split")), "source")


def pools(words: DataFrame, seed: int = 7) -> DataFrame:
    """Distinct texts (the last of equal ones) in an 80/10/10 split by hash."""
    last = words.groupBy("text").agg(F.max("seq").alias("seq"))
    h = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(10))
    return last.withColumn("split", F.when(h < 8, "train").when(h == 8, "validation").otherwise("test"))


def representatives(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return best(rows, keys, 1, *order)


def best(rows: DataFrame, keys: list[str], most: int, *order) -> DataFrame:
    """The first ``most`` rows of each key with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= most)


def distinct_in_order(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Rows whose key has not come before."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).filter("_k = 1").drop("_k")
