"""Evidence fusion, decisions by beam search, and compact backup strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEAM, CHOICES, OUTPUT = 32, 5, 12


def fused(candidates: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """Candidates of a position merged by char: summed score capped at one, the largest
    score, the best rank and the sources; ordered by the score with the bonus for
    agreeing sources and the penalty for a lone one."""
    per = candidates.filter(F.coalesce("char", F.lit("")) != "").groupBy(*keys, "char", F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("s"), F.max(F.coalesce("score", F.lit(0.0))).alias("m"), F.min("rank").alias("r"))
    out = per.groupBy(*keys, "char").agg(F.sum("s").alias("sum"), F.greatest(F.max("m"), F.lit(0.0)).alias("largest"), F.min("r").alias("best_rank"), F.count_if(F.col("s") > 0).alias("sources"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("from"))
    score = F.least(F.lit(1.0), F.col("sum"))
    ready = score + F.least(F.lit(0.18), F.greatest(F.lit(0), F.col("sources") - 1) * 0.06) - F.when(F.col("sources") <= 1, 0.20).otherwise(0.0)
    out = out.withColumns({"score": score, "ready": ready})
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("ready", 9)), "char")
    return out.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def top_by_source(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The strongest char of each source of a position, and how many chars compete."""
    best = candidates.groupBy(*keys, "source").agg(F.max_by("char", F.struct("score", -F.col("rank"))).alias("char"))
    return best.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat("source", F.lit("="), "char"))), ",").alias("tops"), F.countDistinct("char").alias("chars"))


def candidate_score(score: Column, confidence: Column, sources: Column, conflict: Column) -> Column:
    """Evidence terms of one candidate of a position."""
    bonus = F.least(F.lit(0.18), F.greatest(F.lit(0), sources - 1) * 0.06)
    return score * 0.72 + confidence * 0.28 + bonus - F.when(sources <= 1, 0.22).otherwise(0.0) - F.when(conflict, 0.08).otherwise(0.0)


def choices(scored: DataFrame, keys: list[str], positions: DataFrame) -> DataFrame:
    """Per position at most CHOICES ranked chars; a position without any gets an empty char."""
    order = Window.partitionBy(*keys, "position").orderBy(F.desc("score"), "rank")
    ranked = scored.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= CHOICES)
    lists = ranked.groupBy(*keys, "position").agg(F.array_sort(F.collect_list(F.struct("nth", "char", "score"))).alias("choices"))
    empty = F.array(F.struct(F.lit(1).alias("nth"), F.lit("").alias("char"), F.lit(-0.65).alias("score")))
    return positions.join(lists, [*keys, "position"], "left").withColumn("choices", F.coalesce("choices", empty))


_BEAMS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("total", T.DoubleType())]))


def beams(positions: Column, width: int = BEAM, output: int = OUTPUT) -> Column:
    """Fold of positions (arrays of choices) into the best texts and their summed scores.

    After each position the ``width`` best stay: larger sum, shorter text, then text."""

    def order(a, b):
        return F.when(a["total"] > b["total"], -1).when(a["total"] < b["total"], 1).when(F.length(a["text"]) != F.length(b["text"]), F.sign(F.length(a["text"]) - F.length(b["text"])).cast("int")).when(a["text"] < b["text"], -1).when(a["text"] > b["text"], 1).otherwise(0)

    def step(held, position):
        grown = F.flatten(F.transform(held, lambda h: F.transform(position, lambda c: F.struct(F.concat(h["text"], c["char"]).alias("text"), (h["total"] + c["score"]).alias("total")))))
        return F.slice(F.array_sort(grown, order), 1, width)

    start = F.array(F.struct(F.lit("").alias("text"), F.lit(0.0).alias("total"))).cast(_BEAMS)
    return F.slice(F.aggregate(positions, start, step), 1, output)


def decisions(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Ranked word candidates of each token with average and summed score."""
    rows = chosen.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "choices"))), lambda x: x["choices"]).alias("p"))
    rows = rows.withColumns({"best": beams(F.col("p")), "n": F.size("p")})
    out = rows.select(*keys, "n", F.posexplode("best").alias("k", "b"))
    return out.select(*keys, (F.col("k") + 1).alias("rank"), "b.text", F.col("b.total").alias("total"), (F.col("b.total") / F.greatest(F.lit(1), F.col("n"))).alias("score"))


def backup_string(chars: Column) -> Column:
    """``l:a,b:b`` from ranked chars of a position."""
    return F.array_join(F.transform(chars, lambda c, i: F.concat(F.when(i == 0, "l:").otherwise("b:"), c)), ",")


def parsed_backups(compact: Column) -> Column:
    """Positions (selected, chars) of ``l:a,b:b|l:c``: the last ``l`` leads and is selected,
    without one the first backup is; repeated chars and empty entries go."""
    entries = F.filter(F.transform(F.split(F.replace(compact, F.lit("\n"), F.lit("|")), r"\|"), F.trim), lambda e: e != "")

    def position(entry):
        parts = F.filter(F.split(entry, ","), lambda p: F.instr(p, ":") > 0)
        kinds = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("kind"), F.trim(F.substr(p, F.instr(p, ":") + 1)).alias("char")))
        kept = F.filter(kinds, lambda k: k["kind"].isin("l", "b") & (k["char"] != ""))
        # each selected char goes to the front, so the last one leads
        lead = F.reverse(F.transform(F.filter(kept, lambda k: k["kind"] == "l"), lambda k: k["char"]))
        chars = F.array_distinct(F.concat(lead, F.transform(F.filter(kept, lambda k: k["kind"] == "b"), lambda k: k["char"])))
        return F.struct(F.try_element_at(chars, F.lit(1)).alias("selected"), chars.alias("chars"))

    return F.filter(F.transform(entries, position), lambda p: p["selected"].isNotNull())
