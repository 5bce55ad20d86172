"""Letter n-gram plausibility: counts, smoothed log probabilities, z-scores, repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDERS, SMOOTHING, TRAINING_WORDS = (2, 3, 4), 0.1, 50_000
GIBBERISH_Z, FLOOR = -2.0, 1e-12


def exploded(words: DataFrame, *keep: str, orders=ORDERS) -> DataFrame:
    """Rows of order and ngram for each n-gram of each word.

    A word has as many n-grams of each order as it has letters and one more, so one
    step over its places gives all of them, in generated code."""
    longest = max(orders)
    padded = words.select(*keep, F.concat(F.lit("^" * (longest - 1)), "word", F.lit("$")).alias("_padded"))
    places = padded.select(*keep, "_padded", F.explode(F.sequence(F.lit(1), F.length("_padded") - longest + 1)).alias("_at"))
    each = [F.struct(F.lit(n).alias("order"), F.substring(F.col("_padded"), F.col("_at") + (longest - n), F.lit(n)).alias("ngram")) for n in orders]
    return places.select(*keep, F.explode(F.array(*each)).alias("g")).select(*keep, "g.order", "g.ngram")


def fit(words: DataFrame, orders=ORDERS) -> DataFrame:
    """Weighted counts of n-grams of (word, count): order, ngram, weight.

    A word weighs log(1 + count)."""
    return exploded(words.withColumn("w", F.log1p(F.col("count").cast("double"))), "w", orders=orders).groupBy("order", "ngram").agg(F.sum("w").alias("weight"))


def totals(model: DataFrame) -> dict[int, tuple[float, int]]:
    """Per order the summed weight and the number of n-grams: one row an order."""
    return {r["order"]: (r["total"], r["size"]) for r in model.groupBy("order").agg(F.sum("weight").alias("total"), F.count("*").alias("size")).collect()}


def log_probability(weight: Column, order: Column, of: dict[int, tuple[float, int]], smoothing: float = SMOOTHING) -> Column:
    """ln((weight + k) / (total + k * vocabulary)); an n-gram without weight is unseen."""
    out = F.lit(None).cast("double")
    for n, (total, size) in of.items():
        p = (weight + smoothing) / F.lit(total + smoothing * size)
        out = F.when(order == n, F.ln(F.greatest(p, F.lit(FLOOR)))).otherwise(out)
    return out


def averages(words: DataFrame, model: DataFrame, of: dict[int, tuple[float, int]]) -> DataFrame:
    """Distinct words (and what else their rows hold) with the mean log probability over
    the n-grams of all orders."""
    keep = words.columns
    seen = model.select("order", "ngram", log_probability(F.col("weight"), F.col("order"), of).alias("seen"))
    scored = exploded(words, *keep).join(seen, ["order", "ngram"], "left")
    first = [F.first(c).alias(c) for c in keep if c != "word"]
    unseen = log_probability(F.lit(0.0), F.col("order"), of)
    return scored.groupBy("word").agg(*first, F.avg(F.coalesce("seen", unseen)).alias("average"))


def spread(scored: DataFrame, most: int = TRAINING_WORDS) -> tuple[float, float]:
    """Mean and population deviation of the scores of the most frequent words."""
    first = scored.orderBy(F.desc("count"), "word").limit(most)
    return first.agg(F.avg("average"), F.greatest(F.stddev_pop("average"), F.lit(1e-6))).first()


def judged(scored: DataFrame, mean: float, deviation: float) -> DataFrame:
    """Adds z, confidence (logistic of z within 12) and whether it looks like gibberish."""
    z = (F.col("average") - mean) / deviation
    confidence = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))))
    return scored.withColumns({"z": z, "confidence": confidence, "gibberish": z < GIBBERISH_Z})


def candidates(tokens: DataFrame, max_positions: int = 6, max_alternatives: int = 5) -> DataFrame:
    """Texts with one or two replaced letters of (token, text, position, char, confidence, rank).

    Positions count from 0; a token's own letter is no alternative. The positions of
    least confidence come first, and of each the alternatives of most."""
    alt = tokens.filter(F.col("char") != F.substring(F.col("text"), F.col("position") + 1, F.lit(1)))
    best = Window.partitionBy("token", "position").orderBy(F.desc("confidence"), "char")
    alt = alt.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= max_alternatives)
    of = Window.partitionBy("token").orderBy("held", "position")
    alt = alt.withColumn("place", F.dense_rank().over(of)).filter(F.col("place") <= max_positions)
    put = lambda text, at, c: F.concat(F.substring(text, F.lit(1), at), c, F.substr(text, at + 2))
    one = alt.select("token", "text", put(F.col("text"), F.col("position"), F.col("char")).alias("repaired"), F.lit(1).alias("changes"), F.greatest(F.lit(0.001), F.col("confidence")).alias("product"))
    a, b = alt.select("token", "text", "position", "char", "confidence"), alt.select("token", F.col("position").alias("p2"), F.col("char").alias("c2"), F.col("confidence").alias("f2"))
    two = a.join(b, "token").filter("position < p2")
    two = two.select("token", "text", put(put(F.col("text"), F.col("position"), F.col("char")), F.col("p2"), F.col("c2")).alias("repaired"), F.lit(2).alias("changes"), (F.greatest(F.lit(0.001), F.col("confidence")) * F.greatest(F.lit(0.001), F.col("f2"))).alias("product"))
    return reduce(DataFrame.unionByName, (one, two))


def repairs(tried: DataFrame, scored: DataFrame, mean: float, deviation: float, least_gain: float = 0.15, most: int = 12) -> DataFrame:
    """The best repairs of each token by z-score gain over its own text."""
    z = lambda name: ((F.col(name) - mean) / deviation)
    own = scored.select(F.col("word").alias("text"), F.col("average").alias("own"))
    new = scored.select(F.col("word").alias("repaired"), F.col("average").alias("new"))
    rows = tried.join(own, "text").join(new, "repaired").select("token", "text", "repaired", "changes", "product", z("new").alias("z"), (z("new") - z("own")).alias("gain")).filter(F.col("gain") >= least_gain)
    order = Window.partitionBy("token").orderBy(F.desc("z"), "changes", F.desc("gain"), F.desc("product"), "repaired")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
