"""Fusion and decisions: three invented experts over line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import fusion as U

from .registry import query

_CAND = """n AS (SELECT l_orderkey AS token, l_linenumber AS position, unnest(['trace', 'glyph', 'word']) AS source, unnest([1, 2, 3]) AS k, l_partkey, l_suppkey, l_discount, l_tax FROM lineitem),
c AS (SELECT token, position, source, substr('aeinorst', ((l_partkey * k + l_suppkey) % 5 + 1)::INT, 1) AS ch, round(CASE source WHEN 'trace' THEN l_discount * 6 WHEN 'glyph' THEN l_tax * 7 ELSE 0.3 END, 6)::DOUBLE AS score, k AS rank FROM n)"""


def candidates(t) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(k).alias("k")) for k, s in enumerate(("trace", "glyph", "word"), 1)])).alias("e")
    n = t.lineitem.select(F.col("l_orderkey").alias("token"), F.col("l_linenumber").alias("position"), each, "l_partkey", "l_suppkey", "l_discount", "l_tax")
    char = F.substring(F.lit("aeinorst"), ((F.col("l_partkey") * F.col("e.k") + F.col("l_suppkey")) % 5 + 1).cast("int"), F.lit(1))
    score = F.round(F.when(F.col("e.source") == "trace", F.col("l_discount") * 6).when(F.col("e.source") == "glyph", F.col("l_tax") * 7).otherwise(0.3), 6)
    return n.select("token", "position", F.col("e.source").alias("source"), char.alias("char"), score.alias("score"), F.col("e.k").alias("rank"))


_FUSED = f"""{_CAND}, s AS (SELECT token, position, ch, source, sum(score) AS s, max(score) AS m, min(rank) AS r FROM c GROUP BY ALL),
f AS (SELECT token, position, ch, least(1.0, sum(s)) AS score, max(m) AS largest, min(r) AS best_rank, count(*) FILTER (s > 0) AS sources, string_agg(source, ',' ORDER BY source) AS from_ FROM s GROUP BY ALL),
g AS (SELECT *, score + least(0.18, greatest(0, sources - 1) * 0.06) - CASE WHEN sources <= 1 THEN 0.20 ELSE 0 END AS ready FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY token, position ORDER BY round(ready, 9) DESC, ch) AS place FROM g)"""


@query("a19_fused_candidates", f"WITH {_FUSED} SELECT token, position, ch AS char, round(score, 6) AS score, round(largest, 6) AS largest, best_rank, sources, from_ AS \"from\", round(ready, 6) AS ready, place FROM r WHERE place <= 8")
def fused_candidates(t):
    return U.fused(candidates(t), ["token", "position"]).select("token", "position", "char", F.round("score", 6).alias("score"), F.round("largest", 6).alias("largest"), "best_rank", "sources", "from", F.round("ready", 6).alias("ready"), F.col("place").cast("bigint").alias("place"))


@query("r10_source_conflicts", f"WITH {_CAND}, b AS (SELECT * FROM (SELECT token, position, source, ch, row_number() OVER (PARTITION BY token, position, source ORDER BY score DESC, rank, ch DESC) AS k FROM c) WHERE k = 1) SELECT token, count(*) FILTER (chars > 1) AS conflicts, count(*) AS positions FROM (SELECT token, position, count(DISTINCT ch) AS chars FROM b WHERE position <= 7 GROUP BY ALL) GROUP BY token")
def source_conflicts(t):
    """Positions at which the sources' strongest chars differ."""
    one = candidates(t).groupBy("token", "position", "source").agg(F.max_by("char", F.struct("score", -F.col("rank"), "char")).alias("char"), F.max("score").alias("score"), F.min("rank").alias("rank"))
    tops = U.top_by_source(one, ["token", "position"])
    return tops.groupBy("token").agg(F.count_if(F.col("chars") > 1).alias("conflicts"), F.count("*").alias("positions"))


def chosen(t) -> DataFrame:
    """Ranked choices of up to two positions of each token."""
    f = U.fused(candidates(t), ["token", "position"]).filter("position <= 2")
    # multiples of 1/1024, so that sums don't depend on their order
    score = F.round(F.round(U.candidate_score(F.col("score"), F.col("score"), F.col("sources"), F.lit(False)), 9) * 1024) / 1024
    scored = f.select("token", "position", "char", score.alias("score"), F.col("place").alias("rank"))
    return U.choices(scored, ["token"], scored.select("token", "position").distinct())


_CHOSEN = f"""{_FUSED}, h AS (SELECT token, position, ch, place, round(round(score * 0.72 + score * 0.28 + least(0.18, greatest(0, sources - 1) * 0.06) - CASE WHEN sources <= 1 THEN 0.22 ELSE 0 END, 9) * 1024) / 1024 AS score FROM r WHERE place <= 8 AND position <= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY token, position ORDER BY score DESC, place) AS nth FROM h),
a AS (SELECT * FROM k WHERE nth <= 5), z AS (SELECT token, count(DISTINCT position) AS n FROM a GROUP BY token),
w AS (SELECT x.token, x.ch || coalesce(y.ch, '') AS text, x.score + coalesce(y.score, 0) AS total, n FROM a x JOIN z USING (token) LEFT JOIN a y ON y.token = x.token AND y.position > x.position WHERE x.position = (SELECT min(position) FROM a q WHERE q.token = x.token)),
v AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY round(total, 9) DESC, length(text), text) AS rank FROM w)"""


@query("r11_beam_decisions", f"WITH {_CHOSEN} SELECT token, rank, text, round(total, 6) AS total, round(total / n, 6) AS score FROM v WHERE rank <= 12")
def beam_decisions(t):
    out = U.decisions(chosen(t), ["token"])
    return out.select("token", F.col("rank").cast("bigint").alias("rank"), "text", F.round("total", 6).alias("total"), F.round("score", 6).alias("score"))


@query("w4_position_scores", f"WITH {_FUSED} SELECT token, position, ch AS char, round(score * 0.72 + score * 0.28 + least(0.18, greatest(0, sources - 1) * 0.06) - CASE WHEN sources <= 1 THEN 0.22 ELSE 0 END - CASE WHEN count(*) OVER (PARTITION BY token, position) > 1 THEN 0.08 ELSE 0 END, 6) + 0.0::DOUBLE AS score FROM r WHERE place <= 8")
def position_scores(t):
    from pyspark.sql import Window

    f = U.fused(candidates(t), ["token", "position"])
    conflict = F.count("*").over(Window.partitionBy("token", "position")) > 1
    return f.select("token", "position", "char", (F.round(U.candidate_score(F.col("score"), F.col("score"), F.col("sources"), conflict), 6) + 0.0).alias("score"))


@query("r9_position_grid", "WITH s AS (SELECT o_orderkey AS unit, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS segments, o_custkey % 6 AS words FROM orders) SELECT unit, p AS position, p < segments AS has_segment, p < words AS has_word FROM s, unnest(range(0, greatest(segments, words, 1))) t(p)")
def position_grid(t):
    """Positions of a unit: as many as segments or word tokens, at least one."""
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("unit")).agg(F.count("*").alias("segments"))
    s = t.orders.select(F.col("o_orderkey").alias("unit"), (F.col("o_custkey") % 6).alias("words")).join(n, "unit", "left").withColumn("segments", F.coalesce("segments", F.lit(0)))
    return s.select("unit", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest("segments", "words", F.lit(1)) - 1)).alias("position"), "segments", "words").select("unit", "position", (F.col("position") < F.col("segments")).alias("has_segment"), (F.col("position") < F.col("words")).alias("has_word"))


@query("f7_backup_strings", f"WITH {_FUSED}, b AS (SELECT token, position, string_agg(CASE WHEN place = 1 THEN 'l:' ELSE 'b:' END || ch, ',' ORDER BY place) AS s FROM r WHERE place <= 8 GROUP BY ALL) SELECT token, string_agg(s, '|' ORDER BY position) AS backups, string_agg(substr(s, 3, 1), '' ORDER BY position) AS text, count(*) AS positions FROM b GROUP BY token")
def backup_strings(t):
    """Written as compact strings and parsed back: the text is that of the selected chars."""
    f = U.fused(candidates(t), ["token", "position"])
    per = f.groupBy("token", "position").agg(U.backup_string(F.transform(F.array_sort(F.collect_list(F.struct("place", "char"))), lambda x: x["char"])).alias("s"))
    rows = per.groupBy("token").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "s"))), lambda x: x["s"]), "|").alias("backups"))
    parsed = U.parsed_backups(F.col("backups"))
    return rows.withColumn("p", parsed).select("token", "backups", F.array_join(F.transform("p", lambda x: x["selected"]), "").alias("text"), F.size("p").cast("bigint").alias("positions"))
