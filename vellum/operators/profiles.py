"""Empirical profiles of classes: distributions, modes, signatures, errors, likelihoods.

Input is long: one row per sample and feature. Every order has a unique tie-break
(the first sample seen), and percents are whole numbers before any threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.columns import percent

# Importance of features, as weight and as rank.
WEIGHTS = {"high": 1.0, "medium": 0.55, "low": 0.2, "unknown": 0.1}
RANKS = {"high": 0, "medium": 1, "low": 2, "unknown": 3}


def _of(mapping: dict, c, default):
    out = F.lit(default)
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def distributions(long: DataFrame) -> DataFrame:
    """(class, feature, value, seq) to counts with percent of the feature's total and rank."""
    counts = long.groupBy("class", "feature", "value").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    of = Window.partitionBy("class", "feature")
    ranked = counts.withColumns({"total": F.sum("n").over(of), "rank": F.row_number().over(of.orderBy(F.desc("n"), "first"))})
    return ranked.withColumn("percent", percent(F.col("n"), F.col("total")))


def modes(profile: DataFrame) -> DataFrame:
    """The most common value of each class and feature, with its support."""
    best = F.max_by(F.struct("value", "n", "percent"), F.struct("n", -F.col("first")))
    return profile.groupBy("class", "feature").agg(best.alias("b")).select("class", "feature", "b.value", "b.n", "b.percent")


def common(profile: DataFrame, least: int = 50) -> DataFrame:
    return profile.filter(F.col("percent") >= least)


def secondary(profile: DataFrame, least: int = 10, below: int = 50) -> DataFrame:
    return profile.filter((F.col("percent") >= least) & (F.col("percent") < below))


def signatures(long: DataFrame, most: int = 3) -> DataFrame:
    """The commonest joint feature maps of each class, with the first sample that has one."""
    per = long.groupBy("class", "sample").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("f"), F.min("seq").alias("seq"))
    named = per.withColumn("signature", F.array_join(F.transform("f", lambda x: F.concat(x["feature"], F.lit("="), x["value"])), ","))
    counts = named.groupBy("class", "signature").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.min_by("sample", "seq").alias("example"))
    of = Window.partitionBy("class")
    return counts.withColumns({"total": F.sum("n").over(of), "rank": F.row_number().over(of.orderBy(F.desc("n"), "first"))}).filter(F.col("rank") <= most).withColumn("percent", percent(F.col("n"), F.col("total")))


def numbers(long: DataFrame) -> DataFrame:
    """(class, feature, number) to statistics over finite numbers."""
    x = F.col("number")
    finite = long.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    aggs = {"mean": F.avg(x), "median": F.percentile(x, F.lit(0.5)), "low": F.min(x), "high": F.max(x), "p10": F.percentile(x, F.lit(0.1)), "p90": F.percentile(x, F.lit(0.9)), "deviation": F.stddev_pop(x)}
    return finite.groupBy("class", "feature").agg(F.count("*").alias("n"), *[F.round(v, 6).alias(k) for k, v in aggs.items()])


def errors(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Differing (class, feature, expected, observed) counted, as percent of (class, samples)."""
    counts = pairs.filter(F.col("expected") != F.col("observed")).groupBy("class", "feature", "expected", "observed").agg(F.count("*").alias("n"))
    return counts.join(samples, "class").withColumn("percent", percent(F.col("n"), F.col("samples")))


def watchlist(now: DataFrame, before: DataFrame, watch: int = 10, rise: int = 5) -> DataFrame:
    """Errors that reach ``watch`` percent or rose by ``rise`` points since the last profile."""
    key = ["class", "feature", "expected", "observed"]
    both = now.join(before.select(*key, F.col("percent").alias("previous")), key, "left").withColumn("previous", F.coalesce("previous", F.lit(0)))
    both = both.withColumn("delta", F.col("percent") - F.col("previous")).filter((F.col("percent") >= watch) | (F.col("delta") >= rise))
    return both.withColumn("reason", F.when(F.col("percent") >= watch, "reached_watch_threshold").otherwise("rising_minor_error"))


def likelihoods(observed: DataFrame, profile: DataFrame, importance: DataFrame, temperature: float = 3.0) -> DataFrame:
    """Weighted naive Bayes of (obs, feature, value) against all classes of a profile.

    A value's probability is smoothed by one half over the values seen (one more for
    an unseen value, two at least); a feature weighs its importance times the support
    of its mode (0.15 at least). Likelihoods are a softmax at ``temperature``."""
    per = profile.groupBy("class", "feature").agg(F.max("total").alias("total"), F.count("*").alias("size"), (F.max(F.when(F.col("rank") == 1, F.col("percent"))) / 100.0).alias("support"))
    per = per.join(importance, "feature", "left").withColumn("weight", _of(WEIGHTS, F.coalesce("importance", F.lit("unknown")), 0.1) * F.greatest(F.lit(0.15), F.col("support")))
    # equal observations are scored once: there are as many as distinct pairs
    asked = observed.select("feature", "value").distinct()
    known = asked.join(per, "feature").join(profile.select("class", "feature", "value", "n"), ["class", "feature", "value"], "left")
    count = F.coalesce("n", F.lit(0))
    categories = F.greatest(F.lit(2), F.col("size") + F.when(count == 0, 1).otherwise(0))
    p = (count + 0.5) / (F.col("total") + 0.5 * categories)
    terms = known.select("class", "feature", "value", "weight", (F.col("weight") * F.ln(F.greatest(p, F.lit(1e-12)))).alias("term"))
    sums = observed.join(terms, ["feature", "value"]).groupBy("obs", "class").agg(F.sum("term").alias("log_score"), F.sum("weight").alias("weight"), F.count("*").alias("coverage"))
    of = Window.partitionBy("obs")
    e = F.exp((F.col("log_score") - F.max("log_score").over(of)) / temperature)
    out = sums.withColumns({"e": e, "compatibility": F.exp(F.col("log_score") / F.col("weight"))})
    out = out.withColumn("likelihood", F.col("e") / F.sum("e").over(of)).withColumn("relative", F.col("likelihood") * F.count("*").over(of))
    return out.withColumn("rank", F.row_number().over(of.orderBy(F.desc(F.round("likelihood", 12)), "class"))).withColumn("last", F.count("*").over(of) - F.col("rank")).drop("e")


def effects(scores: DataFrame, boost: float = 1.4, weaken: float = 0.35) -> DataFrame:
    """Soft effects: a boost among the first five, a weakening among the last five."""
    r = F.col("relative")
    up, down = (F.col("rank") <= 5) & (r >= boost), (F.col("last") < 5) & (r <= weaken)
    one = scores.filter(up).select("obs", "class", F.lit("boost").alias("effect"), F.greatest(F.lit(0.01), F.least(F.lit(1.0), (r - boost) / 3.0)).alias("strength"))
    two = scores.filter(down).select("obs", "class", F.lit("weaken").alias("effect"), F.greatest(F.lit(0.01), F.least(F.lit(1.0), (weaken - r) / weaken)).alias("strength"))
    return one.unionByName(two)
