"""Signals: the events of a user in order of id, their value as height."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators import sequences as Q

from .registry import query

_SIG = "s AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, round(value / 10) AS y, event_type, event_id FROM events)"


def signal(t) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return t.events.select(F.col("user_id").alias("u"), i.cast("bigint").alias("i"), F.round(F.col("value") / 10).alias("y"), "event_type", "event_id")


@query("w12_ctc_decoding", f"WITH {_SIG}, x AS (SELECT u, i, (event_id * 7 // 3) % 4 AS token, y FROM s), m AS (SELECT *, token IS DISTINCT FROM lag(token) OVER (PARTITION BY u ORDER BY i) AS new FROM x), r AS (SELECT *, sum(new::INT) OVER (PARTITION BY u ORDER BY i) AS run FROM m) SELECT u, row_number() OVER (PARTITION BY u ORDER BY min(i)) AS index, token, min(i) AS start, max(i) AS stop, round(avg(y), 6) AS confidence FROM r WHERE token <> 0 GROUP BY u, run, token")
def ctc_decoding(t):
    steps = signal(t).select("u", F.col("i").alias("step"), (F.floor(F.col("event_id") * 7 / 3) % 4).alias("token"), F.col("y").alias("confidence"))
    return Q.decoded(steps, ["u"]).select("u", F.col("index").cast("bigint").alias("index"), "token", "start", "stop", F.round("confidence", 6).alias("confidence"))


_RUNS = f"""WITH {_SIG}, d AS (SELECT * FROM (SELECT u, i, y, sign(y - lag(y) OVER (PARTITION BY u ORDER BY i)) AS d FROM s) WHERE d <> 0), m AS (SELECT *, sum((d IS DISTINCT FROM p)::INT) OVER (PARTITION BY u ORDER BY i) AS run FROM (SELECT *, lag(d) OVER (PARTITION BY u ORDER BY i) AS p FROM d)),
r AS (SELECT u, run, any_value(d) AS d, max(i) AS last, arg_max(y, i) AS ending FROM m GROUP BY u, run), n AS (SELECT *, coalesce(lag(ending) OVER w, (SELECT arg_min(y, i) FROM s WHERE s.u = r.u)) AS begin_, lead(ending) OVER w AS next_ FROM r WINDOW w AS (PARTITION BY u ORDER BY run)),
e AS (SELECT u, last AS i, ending AS y, CASE WHEN d > 0 THEN 'max' ELSE 'min' END AS kind, least(abs(ending - begin_), abs(ending - next_)) AS prominence FROM n WHERE next_ IS NOT NULL)"""


@query("w5_local_extrema", f"{_RUNS} SELECT u, i, y, kind, prominence FROM e")
def local_extrema(t):
    return Q.extrema(signal(t).select("u", "i", "y"), ["u"])


@query("w6_spaced_extrema")
def spaced_extrema(t):
    """Extrema that no more prominent one within four places suppresses."""
    e = Q.extrema(signal(t).select("u", "i", "y"), ["u"]).groupBy("u").agg(F.collect_list(F.struct(F.col("prominence").alias("weight"), "i")).alias("c"))
    return e.select("u", F.explode(Q.spaced(F.col("c"), 4)).alias("x")).select("u", "x.i", F.col("x.weight").alias("prominence"))


@query("o8_spaced_boundaries")
def spaced_boundaries(t):
    """At most six boundary peaks of a unit from a threshold on, at least three bins apart."""
    p = Q.peaks(signal(t).select("u", "i", "y"), ["u"], 2.0).groupBy("u").agg(F.collect_list(F.struct(F.col("y").alias("weight"), "i")).alias("c"))
    return p.select("u", F.explode(Q.spaced(F.col("c"), 3, 6)).alias("x")).select("u", "x.i", "x.weight")


@query("w8_plateau_minima", f"WITH {_SIG}, m AS (SELECT *, y IS DISTINCT FROM lag(y) OVER (PARTITION BY u ORDER BY i) AS new FROM s), r AS (SELECT *, sum(new::INT) OVER (PARTITION BY u ORDER BY i) AS run FROM m), f AS (SELECT u, run, any_value(y) AS y, min(i) AS a, max(i) AS b FROM r GROUP BY u, run), n AS (SELECT *, lag(y) OVER w AS l, lead(y) OVER w AS r FROM f WINDOW w AS (PARTITION BY u ORDER BY run)) SELECT u, (a + b) // 2 AS i, y FROM n WHERE l > y AND r > y")
def plateau_minima(t):
    return Q.minima(signal(t).select("u", "i", "y"), ["u"])


@query("w9_smoothed_valleys", f"WITH {_SIG}, m AS (SELECT u, i, sum(y) OVER (PARTITION BY u ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS smooth FROM s) SELECT u, i, round(smooth, 6) AS smooth FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY smooth, i) AS k FROM m) WHERE k = 1")
def smoothed_valleys(t):
    """The lowest place of each smoothed signal."""
    s = Q.smoothed(signal(t).select("u", "i", "y"), ["u"])
    return s.groupBy("u").agg(F.min(F.struct("smooth", "i")).alias("m")).select("u", "m.i", F.round("m.smooth", 6).alias("smooth"))


@query("w10_text_bands", f"WITH {_SIG}, o AS (SELECT u, i, i - lag(i) OVER (PARTITION BY u ORDER BY i) - 1 AS gap FROM s WHERE y >= 2), b AS (SELECT *, sum((coalesce(gap, 3) > 2)::INT) OVER (PARTITION BY u ORDER BY i) AS band FROM o) SELECT u, band::BIGINT AS band, min(i) AS start, max(i) AS stop FROM b GROUP BY u, band HAVING max(i) - min(i) + 1 >= 2")
def text_bands(t):
    return Q.bands(signal(t).select("u", "i", "y"), ["u"], 2.0, 2, 2)


@query("w11_boundary_peaks", f"WITH {_SIG}, n AS (SELECT u, i, y, coalesce(lag(y) OVER w, '-infinity'::DOUBLE) AS l, coalesce(lead(y) OVER w, '-infinity'::DOUBLE) AS r FROM s WINDOW w AS (PARTITION BY u ORDER BY i)) SELECT u, i, y FROM n WHERE y >= 3 AND y >= l AND y >= r")
def boundary_peaks(t):
    return Q.peaks(signal(t).select("u", "i", "y"), ["u"], 3.0)


@query("w13_heatmaps", "WITH p AS (SELECT DISTINCT user_id AS u, event_id % 64 AS bin FROM events WHERE event_type = 'click'), h AS (SELECT u, bin + o AS bin, 1 - abs(o) / 3.0 AS heat FROM p, unnest(range(-2, 3)) t(o)) SELECT u, bin, round(max(heat), 6)::DOUBLE AS heat FROM h WHERE bin BETWEEN 0 AND 63 GROUP BY ALL")
def heatmaps(t):
    p = t.events.filter("event_type = 'click'").select(F.col("user_id").alias("u"), (F.col("event_id") % 64).alias("bin")).distinct()
    return Q.heat(p, ["u"]).select("u", "bin", F.round("heat", 6).alias("heat"))


@query("w7_path_directions", """WITH p AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, (event_id * 5 % 13)::BIGINT AS x, (event_id * 3 % 7)::BIGINT AS y FROM events), s AS (SELECT * FROM (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM p WINDOW w AS (PARTITION BY u ORDER BY i)) WHERE dx IS NOT NULL),
v AS (SELECT *, sign(dx) AS sx, sign(dy) AS sy, sqrt((dx * dx + dy * dy)::DOUBLE) AS len FROM s), c AS (SELECT *, lag(sx) OVER w AS px, lag(sy) OVER w AS py FROM v WINDOW w AS (PARTITION BY u ORDER BY i)),
a AS (SELECT u, count(*) FILTER (px <> sx OR py <> sy) AS changes, count(*) FILTER (px * sy - py * sx > 0) AS "left", count(*) FILTER (px * sy - py * sx < 0) AS "right", sum(len) AS length FROM c GROUP BY u),
h AS (SELECT u, sum(-q * log2(q)) AS entropy FROM (SELECT u, count(*) / sum(count(*)) OVER (PARTITION BY u) AS q FROM v GROUP BY u, sx, sy) GROUP BY u),
e AS (SELECT u, sqrt(((arg_max(x, i) - arg_min(x, i)) ** 2 + (arg_max(y, i) - arg_min(y, i)) ** 2)::DOUBLE) AS span FROM p GROUP BY u)
SELECT u, changes, "left", "right", round(length, 6) AS length, round(entropy, 6) AS entropy, round(CASE WHEN length > 0 THEN span / length ELSE 0 END, 6) AS straightness FROM a JOIN h USING (u) JOIN e USING (u)""")
def path_directions(t):
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    p = t.events.select(F.col("user_id").alias("u"), i.alias("i"), (F.col("event_id") * 5 % 13).alias("x"), (F.col("event_id") * 3 % 7).alias("y"))
    return Q.directions(p, ["u"]).select("u", "changes", "left", "right", F.round("length", 6).alias("length"), F.round("entropy", 6).alias("entropy"), F.round("straightness", 6).alias("straightness"))


@query("w15_landmarks", """WITH p AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, (event_id * 5 % 13)::BIGINT AS x, (event_id * 3 % 7)::BIGINT AS y FROM events),
l AS (SELECT u, unnest(['leftmost', 'rightmost', 'topmost', 'bottommost']) AS kind, unnest([arg_min(i, x * 1000000 + y * 10000 + i), arg_min(i, -x * 1000000 + y * 10000 + i), arg_min(i, y * 1000000 + x * 10000 + i), arg_min(i, -y * 1000000 + x * 10000 + i)]) AS i FROM p GROUP BY u)
SELECT u, kind, i, row_number() OVER (PARTITION BY u ORDER BY i, kind) AS id FROM l""")
def landmarks(t):
    """First extreme points of a path by coordinate, with the other coordinate as tie-break."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    p = t.events.select(F.col("user_id").alias("u"), i.cast("bigint").alias("i"), (F.col("event_id") * 5 % 13).alias("x"), (F.col("event_id") * 3 % 7).alias("y"))
    x, y = F.col("x"), F.col("y")
    best = {"leftmost": (x, y), "rightmost": (-x, y), "topmost": (y, x), "bottommost": (-y, x)}
    rows = p.groupBy("u").agg(*[F.min_by("i", F.struct(a.alias("a"), b.alias("b"), F.col("i"))).alias(k) for k, (a, b) in best.items()]).unpivot(["u"], list(best), "kind", "i")
    return rows.select("u", "kind", "i", F.row_number().over(Window.partitionBy("u").orderBy("i", "kind")).cast("bigint").alias("id"))
