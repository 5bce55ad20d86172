"""Model evaluation: confusion, precision and recall, hit rates, boundaries, utility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.columns import per


def confusion(rows: DataFrame, keep_equal: bool = False) -> DataFrame:
    """(truth, said) counted, with the share of the true class; equal pairs only on request."""
    counts = rows.groupBy("truth", "said").agg(F.count("*").alias("n"))
    out = counts.withColumn("support", F.sum("n").over(Window.partitionBy("truth"))).withColumn("share", per(F.col("n"), F.col("support")))
    return out if keep_equal else out.filter("truth <> said")


def per_class(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of every class that is true or said, 4 places, zero-safe."""
    each = rows.select(F.explode(F.array(F.struct(F.col("truth").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("s"), F.lit(0).alias("h")), F.struct(F.col("said").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("s"), (F.col("truth") == F.col("said")).cast("int").alias("h")))).alias("x")).select("x.*")
    sums = each.groupBy("class").agg(F.sum("t").alias("support"), F.sum("s").alias("said"), F.sum("h").alias("hits"))
    out = sums.withColumns({"p": per(F.col("hits"), F.col("said")), "r": per(F.col("hits"), F.col("support"))})
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return out.select("class", "support", "said", "hits", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"))


def top_k(scores: Column, k: int) -> Column:
    """The k best of an array of scores as struct(class_id, score): best first, then the lower id."""
    paired = F.transform(scores, lambda s, i: F.struct((-s.cast("double")).alias("key"), i.alias("class_id"), s.cast("double").alias("score")))
    return F.transform(F.slice(F.array_sort(paired), 1, k), lambda x: F.struct(x["class_id"].alias("class_id"), x["score"].alias("score")))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores).cast("double")
    e = F.transform(scores, lambda s: F.exp(s.cast("double") - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def entropy(p: Column) -> Column:
    """Entropy over its largest value, 0 to 1."""
    h = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    return h / F.greatest(F.ln(F.size(p).cast("double")), F.lit(1e-12))


def boundaries(rows: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 of sets of bins, exact rows, and counts within one."""
    common = F.size(F.array_intersect("truth", "said"))
    n = rows.agg(F.sum(common).alias("tp"), F.sum(F.size("said") - common).alias("fp"), F.sum(F.size("truth") - common).alias("fn"), F.avg((F.array_sort("truth") == F.array_sort("said")).cast("int")).alias("exact"), F.avg((F.abs(F.size("truth") - F.size("said")) <= 1).cast("int")).alias("count_within_one"))
    p, r = per(F.col("tp"), F.col("tp") + F.col("fp")), per(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def utility(metrics: dict[str, Column], weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for k, w in weights.items():
        out = out + F.coalesce(metrics[k], F.lit(0.0)) * w
    return out


def memory(sources: list[tuple[str, float, DataFrame]]) -> DataFrame:
    """(predicted, true) over weighted confusion sources: summed weight, largest share, names.

    Sources give truth, said, n and share; equal pairs are dropped."""
    every = None
    for name, weight, rows in sources:
        part = rows.filter("truth <> said").select(F.col("said").alias("predicted"), F.col("truth").alias("true"), (F.col("n") * weight).alias("weighted"), "share", F.lit(name).alias("source"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("predicted", "true").agg(F.sum("weighted").alias("weighted"), F.max("share").alias("share"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def risk(weighted: Column, share: Column) -> Column:
    """Chance that a prediction stands for another truth, 0 to 1."""
    return F.least(F.lit(1.0), F.coalesce(weighted, F.lit(0.0)) / 20.0 * 0.55 + F.coalesce(share, F.lit(0.0)) * 0.45)
