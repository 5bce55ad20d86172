"""Record projections over events, line items, parts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import records as R
from vellum.operators import routing

from .registry import query


@query("p20_label_aliases", "SELECT event_id, coalesce(nullif(json_extract_string(d, '$.label'), ''), nullif(json_extract_string(d, '$.char'), ''), nullif(json_extract_string(d, '$.metadata.label'), '')) AS label FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{\"label\": \"' || event_type || '\"}' WHEN 1 THEN '{\"label\": \"\", \"char\": \"c' || user_id || '\"}' WHEN 2 THEN '{\"metadata\": {\"label\": \"m' || user_id || '\"}}' ELSE '{}' END AS d FROM events)")
def label_aliases(t):
    e, q = F.col("event_id"), F.lit('"}')
    d = F.when(e % 4 == 0, F.concat(F.lit('{"label": "'), "event_type", q)).when(e % 4 == 1, F.concat(F.lit('{"label": "", "char": "c'), "user_id", q)).when(e % 4 == 2, F.concat(F.lit('{"metadata": {"label": "m'), "user_id", F.lit('"}}'))).otherwise("{}")
    return t.events.select("event_id", R.alias_of(d, "$.label", "$.char", "$.metadata.label").alias("label"))


@query("p21_flattened_features", "SELECT event_id, coalesce(json_extract_string(props, '$.geometry.k'), json_extract_string(props, '$.k')) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def flattened_features(t):
    return t.events.select("event_id", *R.flattened(F.col("props"), {"k": ("$.geometry.k", "$.k"), "missing": ("$.missing",)}))


@query("p23_class_labels", "WITH c AS (SELECT DISTINCT event_type FROM events) SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1)::BIGINT AS class_id, (event_type IN ('click', 'purchase'))::INT AS printed, (event_type IN ('error', 'purchase'))::INT AS noise FROM c")
def class_labels(t):
    from pyspark.sql import Window

    c = t.events.select("event_type").distinct()
    return c.select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("bigint").alias("class_id"), F.col("event_type").isin("click", "purchase").cast("int").alias("printed"), F.col("event_type").isin("error", "purchase").cast("int").alias("noise"))


@query("f8_greedy_tokens", r"SELECT word, n, CASE WHEN array_to_string(t, '') = word THEN array_to_string(t, ' ') END AS tokens FROM (SELECT word, count(*) AS n, regexp_extract_all(word, 'tion|ing|th|er|on|an|a|d|e|g|h|i|n|o|r|s|t') AS t FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS word FROM documents) GROUP BY word)")
def greedy_tokens(t):
    from .language import vocabulary

    return vocabulary(t).select("word", F.col("count").alias("n"), F.array_join(R.tokenized(F.col("word"), ["a", "an", "d", "e", "er", "g", "h", "i", "ing", "n", "o", "on", "r", "s", "t", "th", "tion"]), " ").alias("tokens"))


@query("f11_word_trust", "SELECT l_orderkey, l_linenumber, round((CASE WHEN l_linenumber <> l_suppkey % 7 THEN 0.35 ELSE 1.0 END * CASE WHEN l_discount * 10 < 0.5 THEN 0.75 ELSE 1.0 END)::DOUBLE, 6) AS trust FROM lineitem")
def word_trust(t):
    i = F.col
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(R.word_trust(i("l_discount") * 10, i("l_suppkey") % 7, i("l_linenumber")).cast("double"), 6).alias("trust"))


@query("f14_topology_gains", "SELECT p_partkey AS unit, round(0.4 * greatest(-2.0, least(2.0, (p_size % 5 - p_size % 3)::DOUBLE)) + 0.2 * greatest(-3.0, least(3.0, (p_partkey % 7 - p_partkey % 4)::DOUBLE)), 6) AS gain FROM part")
def topology_gains(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    gain = R.topology_gain({"components": s % 5, "endpoints": k % 7}, {"components": s % 3, "endpoints": k % 4}, {"components": (0.4, 2.0), "endpoints": (0.2, 3.0)})
    return t.part.select(k.alias("unit"), F.round(gain, 6).alias("gain"))


@query("f15_crop_quality", "WITH g AS (SELECT p_partkey AS unit, list_transform(range(0, 16), lambda i: ((p_partkey * (i + 1)) % 100) / 100.0) AS g FROM part), m AS (SELECT unit, len(list_filter(g, lambda d: d < 0.01)) / 16 AS e, len(list_filter(g, lambda d: d > 0.8)) / 16 AS f, list_sum(g) / 16 AS a FROM g) SELECT unit, round(greatest(0.0, least(100.0, 100 - 60 * e - 80 * f)), 6)::DOUBLE AS score, array_to_string(list_filter([CASE WHEN e > 0.6 THEN 'mostly_empty' END, CASE WHEN f > 0.3 THEN 'overfilled' END, CASE WHEN a < 0.02 THEN 'too_faint' END], lambda x: x IS NOT NULL), ',') AS faults FROM m")
def crop_quality(t):
    grid = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.col("p_partkey") * (i + 1)) % 100 / 100.0)
    score, faults = R.grid_score(F.col("g"))
    return t.part.select(F.col("p_partkey").alias("unit"), grid.alias("g")).select("unit", F.round(score, 6).alias("score"), F.array_join(faults, ",").alias("faults"))


@query("f16_direction_shares", "SELECT p_partkey AS unit, round(CASE WHEN p_size % 4 + p_size % 3 + p_partkey % 2 > 0 THEN (p_size % 4) / (p_size % 4 + p_size % 3 + p_partkey % 2) ELSE 0 END, 9) AS horizontal, round(CASE WHEN p_size % 4 + p_size % 3 + p_partkey % 2 > 0 THEN (p_size % 3) / (p_size % 4 + p_size % 3 + p_partkey % 2) ELSE 0 END, 9) AS vertical FROM part")
def direction_shares(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    shares = R.direction_shares({"horizontal": s % 4, "vertical": s % 3, "diagonal": k % 2})
    return t.part.select(k.alias("unit"), *[F.round(shares[n].cast("double"), 9).alias(n) for n in ("horizontal", "vertical")])


@query("a23_condition_features", "SELECT l_orderkey AS unit, count(*) AS components, coalesce(max(l_quantity), 0) AS largest, round(coalesce(avg(l_quantity), 0), 9) AS mean, count(*) FILTER (l_quantity < 3) AS isolated, max((l_returnflag = 'R')::INT) AS touched FROM lineitem GROUP BY 1")
def condition_features(t):
    q = F.col("l_quantity")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("unit")).agg(F.count("*").alias("components"), F.coalesce(F.max(q), F.lit(0.0)).alias("largest"), F.round(F.coalesce(F.avg(q), F.lit(0.0)), 9).alias("mean"), F.count_if(q < 3).alias("isolated"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("touched"))


@query("r14_path_hypotheses", "WITH p AS (SELECT l_orderkey AS unit, 'valley' AS tool, round(avg(l_discount) * 5, 9) AS score FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 'word', round(avg(l_tax) * 9, 9) FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 'whole', 0.2 FROM lineitem GROUP BY 1), b AS (SELECT unit, tool, round(greatest(0.0, least(1.0, score + CASE WHEN tool = 'word' AND unit % 3 = 0 THEN 0.15 ELSE 0 END)), 6)::DOUBLE AS score FROM p) SELECT unit, tool, score, row_number() OVER (PARTITION BY unit ORDER BY CASE tool WHEN 'whole' THEN 1 ELSE 0 END, score DESC, tool) AS place FROM b")
def path_hypotheses(t):
    """Hypotheses of three tools, one boosted where it agrees, clamped and ranked."""
    from pyspark.sql import Window

    g = t.lineitem.groupBy(F.col("l_orderkey").alias("unit")).agg(F.round(F.avg("l_discount") * 5, 9).alias("valley"), F.round(F.avg("l_tax") * 9, 9).alias("word"), F.lit(0.2).alias("whole"))
    p = g.unpivot(["unit"], ["valley", "word", "whole"], "tool", "score")
    boost = F.when((F.col("tool") == "word") & (F.col("unit") % 3 == 0), 0.15).otherwise(0.0)
    p = p.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + boost)), 6))
    order = Window.partitionBy("unit").orderBy((F.col("tool") == "whole").cast("int"), F.desc("score"), "tool")
    return p.withColumn("place", F.row_number().over(order).cast("bigint"))


@query("r15_split_wide_segments", "WITH s AS (SELECT DISTINCT l_orderkey AS unit, l_partkey % 500 AS a, l_partkey % 500 + l_quantity::BIGINT * 2 AS b FROM lineitem), w AS (SELECT *, b - a > 1.6 * avg(b - a) OVER (PARTITION BY unit) AS wide FROM s), n AS (SELECT *, wide AND sum(wide::INT) OVER (PARTITION BY unit ORDER BY a, b ROWS UNBOUNDED PRECEDING) <= 2 AS cut FROM w) SELECT unit, a AS start, b AS stop, cut FROM n WHERE NOT cut UNION ALL SELECT unit, a, (a + b) // 2, cut FROM n WHERE cut UNION ALL SELECT unit, (a + b) // 2, b, cut FROM n WHERE cut")
def split_wide_segments(t):
    i = F.col
    s = t.lineitem.select(i("l_orderkey").alias("unit"), (i("l_partkey") % 500).alias("start"), (i("l_partkey") % 500 + i("l_quantity").cast("bigint") * 2).alias("stop")).distinct()
    return R.split_wide(s, ["unit"], 1.6)


@query("b2_route_records", "SELECT l_orderkey AS doc, l_linenumber AS crop, CASE WHEN l_quantity > 48 THEN 'forced' WHEN l_quantity < 3 THEN 'skipped' WHEN l_suppkey % 29 = 0 THEN 'failed' ELSE 'classified' END AS kind, round_even(l_discount / 3, 6)::DOUBLE AS printed, CASE WHEN l_quantity < 3 THEN 'too_small' END AS reason, CASE WHEN l_quantity BETWEEN 3 AND 48 AND l_suppkey % 29 = 0 THEN 'unreadable crop' END AS error FROM lineitem")
def route_records(t):
    i = F.col
    kind = F.when(i("l_quantity") > 48, "forced").when(i("l_quantity") < 3, "skipped").when(i("l_suppkey") % 29 == 0, "failed").otherwise("classified")
    return t.lineitem.select(i("l_orderkey").alias("doc"), i("l_linenumber").alias("crop"), kind.alias("kind"), F.bround(i("l_discount") / 3, 6).alias("printed"), F.when(i("l_quantity") < 3, "too_small").alias("reason"), F.when(i("l_quantity").between(3, 48) & (i("l_suppkey") % 29 == 0), "unreadable crop").alias("error"))


@query("b8_selected_paths", "SELECT l_orderkey AS unit, l_partkey AS path, CASE WHEN l_linestatus = 'F' THEN 'selected' ELSE 'candidate' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1")
def selected_paths(t):
    p = t.lineitem.select(F.col("l_orderkey").alias("unit"), F.col("l_partkey").alias("path"), F.when(F.col("l_linestatus") == "F", "selected").otherwise("candidate").alias("status"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"))
    return R.selected_path(p, ["unit"])


@query("b9_interior_edges", "SELECT l_orderkey AS unit, coalesce(array_to_string(list_sort(list_distinct(list(l_partkey % 64) FILTER (l_partkey % 64 BETWEEN 1 AND 62))), ','), '') AS edges FROM lineitem GROUP BY 1")
def interior_edges(t):
    e = F.col("l_partkey") % 64
    return t.lineitem.groupBy(F.col("l_orderkey").alias("unit")).agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list(F.when(e.between(1, 62), e)))), ",").alias("edges"))


@query("b10_path_bounds", "SELECT l_orderkey AS unit, min(l_partkey % 500) AS x1, max(l_partkey % 500 + l_quantity::BIGINT) AS x2, count(*) AS segments, coalesce(nullif(max(l_suppkey % 4), 0), count(*)) AS expected, round(greatest(0.0, least(1.0, abs(count(*) - coalesce(nullif(max(l_suppkey % 4), 0), count(*))) * 0.2)), 6)::DOUBLE AS penalty FROM lineitem GROUP BY 1")
def path_bounds(t):
    """The box over a path's segments, its expected count, and the penalty for missing it."""
    i = F.col
    g = t.lineitem.groupBy(i("l_orderkey").alias("unit")).agg(F.min(i("l_partkey") % 500).alias("x1"), F.max(i("l_partkey") % 500 + i("l_quantity").cast("bigint")).alias("x2"), F.count("*").alias("segments"), F.coalesce(F.nullif(F.max(i("l_suppkey") % 4), F.lit(0).cast("bigint")), F.count("*")).alias("expected"))
    return g.withColumn("penalty", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(F.col("segments") - F.col("expected")) * 0.2)), 6))


@query("b11_repair_queue", "WITH s AS (SELECT l_orderkey AS unit, l_linenumber AS segment, CASE WHEN l_tax >= 0.07 THEN 'light_cut' WHEN l_tax >= 0.05 THEN 'light_blur' ELSE 'clean' END AS damage FROM lineitem) SELECT unit, count(*) AS segments, count(*) FILTER (damage <> 'clean') AS queued, count(*) FILTER (damage = 'clean') AS not_needed FROM s GROUP BY unit")
def repair_queue(t):
    """Segments with a repairable condition are queued, the others need nothing."""
    x = F.col("l_tax")
    damage = F.when(x >= 0.07, "light_cut").when(x >= 0.05, "light_blur").otherwise("clean")
    s = routing.with_repairs(t.lineitem.select(F.col("l_orderkey").alias("unit"), damage.alias("damage"), F.lit(0.9).alias("confidence"), F.lit("damaged").alias("condition")))
    return s.groupBy("unit").agg(F.count("*").alias("segments"), F.count_if(F.size("repairs") > 0).alias("queued"), F.count_if(F.size("repairs") == 0).alias("not_needed"))


@query("b13_candidate_lookup", "WITH c AS (SELECT l_orderkey AS unit, l_returnflag AS ch, sum(l_discount) AS s, count(*) AS n FROM lineitem GROUP BY ALL) SELECT o_orderkey AS unit, o_orderstatus AS wanted, round(coalesce(s, 0), 6)::DOUBLE AS score, coalesce(n, 0) AS sources FROM orders LEFT JOIN c ON unit = o_orderkey AND ch = CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END")
def candidate_lookup(t):
    """A wanted char's score in the array of a unit's candidates, 0 where it isn't there."""
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("unit"), F.col("l_returnflag").alias("ch")).agg(F.sum("l_discount").alias("s"), F.count("*").alias("n"))
    c = per.groupBy("unit").agg(F.collect_list(F.struct("ch", "s", "n")).alias("c"))
    want = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")
    rows = t.orders.select(F.col("o_orderkey").alias("unit"), F.col("o_orderstatus").alias("wanted"), want.alias("w")).join(c, "unit", "left")
    hit = F.try_element_at(F.filter("c", lambda x: x["ch"] == F.col("w")), F.lit(1))
    return rows.select("unit", "wanted", F.round(F.coalesce(hit["s"], F.lit(0.0)), 6).alias("score"), F.coalesce(hit["n"], F.lit(0)).alias("sources"))


@query("b24_boundary_targets", "SELECT l_orderkey AS unit, array_to_string(list_transform(range(0, 16), lambda b: list_contains(list(least(15, round_even((l_partkey % 100) / 100.0 * 15, 0)::INT)), b)::INT), '') AS bins FROM lineitem GROUP BY 1")
def boundary_targets(t):
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("unit")).agg(F.collect_list((F.col("l_partkey") % 100).cast("double")).alias("p"))
    return g.select("unit", F.array_join(R.one_hot_bins(F.col("p"), F.lit(100.0), 16), "").alias("bins"))


@query("b25_snapped_cuts", "WITH c AS (SELECT DISTINCT user_id AS u, event_id % 64 AS cut FROM events WHERE event_type = 'click'), k AS (SELECT user_id AS u, event_id % 64 AS bin, sum(round(value)) AS ink FROM events GROUP BY ALL), r AS (SELECT c.u, cut, bin, row_number() OVER (PARTITION BY c.u, cut ORDER BY ink, abs(bin - cut), bin) AS n FROM c JOIN k ON c.u = k.u AND abs(bin - cut) <= 3) SELECT u, cut, bin FROM r WHERE n = 1")
def snapped_cuts(t):
    c = t.events.filter("event_type = 'click'").select(F.col("user_id").alias("u"), (F.col("event_id") % 64).alias("bin")).distinct()
    k = t.events.groupBy(F.col("user_id").alias("u"), (F.col("event_id") % 64).alias("bin")).agg(F.sum(F.round("value")).alias("ink"))
    return R.snapped(c, k, ["u"], 3)


@query("b23_export_summary", "SELECT p_brand AS source, r AS recipe, count(*) AS rows_, count(*) FILTER (p_size % 11 = 0) AS failed FROM part, unnest(['clean', 'light_cut', 'light_blur']) u(r) GROUP BY ALL")
def export_summary(t):
    """Rows of an export of every source under every recipe, and those that failed."""
    rows = t.part.select(F.col("p_brand").alias("source"), "p_size", F.explode(F.array(F.lit("clean"), F.lit("light_cut"), F.lit("light_blur"))).alias("recipe"))
    return rows.groupBy("source", "recipe").agg(F.count("*").alias("rows_"), F.count_if(F.col("p_size") % 11 == 0).alias("failed"))


@query("w1_ranked_observations", "SELECT l_returnflag AS class, l_linenumber AS feature, n, row_number() OVER (PARTITION BY l_returnflag ORDER BY CASE WHEN l_linenumber % 3 = 0 THEN 0 WHEN l_linenumber % 3 = 1 THEN 1 ELSE 2 END, n DESC, l_linenumber::VARCHAR) AS place FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)")
def ranked_observations(t):
    """Observations by importance, then count, then name."""
    from pyspark.sql import Window

    g = t.lineitem.groupBy(F.col("l_returnflag").alias("class"), F.col("l_linenumber").alias("feature")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("class").orderBy(F.col("feature") % 3, F.desc("n"), F.col("feature").cast("string"))
    return g.withColumn("place", F.row_number().over(order).cast("bigint"))


@query("p8_thresholds", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 10) / 10.0 ELSE 0.45 END::DOUBLE AS printed_threshold, CASE WHEN c_custkey % 4 = 0 THEN 0.3 WHEN c_custkey % 5 = 0 THEN (c_custkey % 7) / 10.0 ELSE 0.45 END::DOUBLE AS handwriting_threshold, 0.65::DOUBLE AS noise_threshold FROM customer")
def thresholds(t):
    """Thresholds of each customer over the defaults; one has an older name."""
    k = F.col("c_custkey")
    pairs = [(F.when(k % 3 == 0, "printed_threshold"), k % 10 / 10.0), (F.when(k % 4 == 0, "handwriting_threshold"), F.lit(0.3)), (F.when(k % 5 == 0, "handwritten_threshold"), k % 7 / 10.0), (F.when(k % 2 == 0, "noise_threshold"), F.lit("none"))]
    entries = F.filter(F.array(*[F.struct(n.alias("k"), v.cast("string").alias("v")) for n, v in pairs]), lambda x: x["k"].isNotNull())
    defaults = {f"{n}_threshold": routing.THRESHOLDS[n] for n in ("printed", "handwriting", "noise")}
    return t.customer.select("c_custkey", *[c.alias(n) for n, c in R.overlaid(F.map_from_entries(entries), defaults, {"handwriting_threshold": "handwritten_threshold"}).items()])


@query("b1_refiner_settings", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'scribemap_2_layers' END AS input_mode, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 9 ELSE 2 END AS crop_padding_px, c_custkey % 5 <> 0 AS correction_routing_enabled, 0.35::DOUBLE AS correction_min_horizontal_span_ratio, 'blue,red,green,unknown_color,black' AS layers_to_refine, 4::BIGINT AS stacked_text_max_segments FROM customer")
def refiner_settings(t):
    k = F.col("c_custkey")
    pairs = [(F.when(k % 2 == 0, "input_group_mode"), F.lit("old")), (F.when(k % 3 == 0, "crop_padding_px"), k % 9), (F.when(k % 5 == 0, "correction_routing_enabled"), F.lit(False)), (F.when(k % 7 == 0, "unknown_name"), F.lit(1))]
    entries = F.filter(F.array(*[F.struct(n.alias("k"), v.cast("string").alias("v")) for n, v in pairs]), lambda x: x["k"].isNotNull())
    made = R.overlaid(F.map_from_entries(entries), R.REFINER, R.REFINER_ALIASES)
    return t.customer.select("c_custkey", *[made[n].alias(n) for n in ("input_mode", "crop_padding_px", "correction_routing_enabled", "correction_min_horizontal_span_ratio", "layers_to_refine", "stacked_text_max_segments")])


@query("b3_replacements", "SELECT l_orderkey AS doc, l_linenumber AS crop, w, h, (w >= 8 AND h >= 8 AND w * h >= 80 AND greatest(w / h, h / w) <= 12) AS candidate FROM (SELECT *, l_quantity::BIGINT * 3 + 1 AS w, l_partkey % 40 + 1 AS h FROM lineitem)")
def replacements(t):
    w, h = F.col("l_quantity").cast("bigint") * 3 + 1, F.col("l_partkey") % 40 + 1
    return t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("crop"), w.alias("w"), h.alias("h"), R.is_replacement(w, h, w * h).alias("candidate"))


@query("b3_crop_masks", """WITH c AS (SELECT ['blue', 'green', 'black', 'red', 'unknown_color', 'pencil'][(l_partkey % 6 + 1)::INT] AS layer FROM lineitem)
SELECT layer, layer AS analysis, CASE layer WHEN 'blue' THEN 'blue_continuity' WHEN 'red' THEN 'red_continuity' ELSE layer END AS analysis_mask, CASE layer WHEN 'blue' THEN 'blue+black' WHEN 'green' THEN 'green+black' WHEN 'red' THEN 'red+blue+black' WHEN 'unknown_color' THEN 'unknown_color+blue+black' ELSE layer END AS context, count(*) AS crops FROM c GROUP BY layer""")
def crop_mask_names(t):
    names = F.array(*map(F.lit, ("blue", "green", "black", "red", "unknown_color", "pencil")))
    c = t.lineitem.select(F.get(names, (F.col("l_partkey") % 6).cast("int")).alias("layer")).groupBy("layer").agg(F.count("*").alias("crops"))
    return c.select("layer", *[F.array_join(v, "+").alias(k) for k, v in R.crop_masks(F.col("layer")).items()], "crops")


def _document(k):
    """Records with a payload under one of several names, empty ones among them."""
    q = F.lit("}")
    own = F.concat(F.lit('{"endpoints":'), k % 5, q)
    made = F.concat(F.lit('{"endpoints":'), k % 5, q)
    for n, doc in enumerate((F.concat(F.lit('{"auto":{},"observed":'), own, q), F.concat(F.lit('{"traced":'), own, F.lit(',"observed":{"endpoints":9}}')), F.concat(F.lit('{"reconstruction":{"selected_scrilog_observation":'), own, F.lit('},"expected":{"endpoints":2}}')), F.concat(F.lit('{"metrics":{"scrilog_observation":'), own, F.lit('},"metadata":{"geometry":{"width":7}}}')))):
        made = F.when(k % 6 == n, doc).otherwise(made)
    return made


@query("p22_payloads", """SELECT event_id, '{"endpoints":' || (event_id % 5) || '}' AS observed, CASE WHEN event_id % 6 = 2 THEN '{"endpoints":2}' END AS expected, CASE WHEN event_id % 6 = 3 THEN '{"width":7}' END AS geometry FROM events""")
def payloads(t):
    doc = _document(F.col("event_id"))
    return t.events.select("event_id", R.observed_payload(doc).alias("observed"), R.expected_payload(doc).alias("expected"), R.geometry_payload(doc).alias("geometry"))


@query("b12_executed_jobs", """WITH s AS (SELECT l_orderkey AS unit, l_linenumber % 2 AS path, l_linenumber AS segment, l_linestatus = 'F' AS selected, l_partkey AS result FROM lineitem),
j AS (SELECT o_orderkey AS unit, o_orderkey % 2 AS path, n AS segment, o_custkey % 3 <> 0 AS asked FROM orders, (SELECT unnest([1, 2, 3, 9]) AS n))
SELECT unit, path, segment, CASE WHEN asked THEN (SELECT min(result) FROM s WHERE s.unit = j.unit AND s.path = j.path AND s.segment = j.segment AND selected) END AS executed FROM j""")
def executed_jobs(t):
    s = t.lineitem.select(F.col("l_orderkey").alias("unit"), (F.col("l_linenumber") % 2).cast("bigint").alias("path"), F.col("l_linenumber").alias("segment"), (F.col("l_linestatus") == "F").alias("selected"), F.col("l_partkey").alias("result"))
    s = s.groupBy("unit", "path", "segment", "selected").agg(F.min("result").alias("result"))
    experts = F.when(F.col("o_custkey") % 3 != 0, F.array(F.lit("glyph"), F.lit("trace"))).otherwise(F.array(F.lit("trace")))
    j = t.orders.select(F.col("o_orderkey").alias("unit"), (F.col("o_orderkey") % 2).alias("path"), F.explode(F.array(*map(F.lit, (1, 2, 3, 9)))).alias("segment"), experts.alias("experts"))
    return R.executed(j, s, "glyph").select("unit", "path", "segment", "executed")


@query("b27_feature_vectors", "SELECT event_id, round(value, 6) AS a, 0.0::DOUBLE AS b, CASE WHEN event_id % 2 = 0 THEN user_id ELSE 0 END::DOUBLE AS c, 0.0::DOUBLE AS d FROM events")
def feature_vectors(t):
    """Named features as a vector; what lacks or is no number is 0."""
    m = F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("kind"), F.col("event_type"), F.lit("user"), F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")), F.lit("bad"), F.lit("NaN"))
    v = R.vector(m, ["value", "kind", "user", "bad"])
    return t.events.select("event_id", F.round(v[0], 6).alias("a"), v[1].alias("b"), v[2].alias("c"), v[3].alias("d"))


@query("b28_refinement_summary", """WITH r AS (SELECT l_orderkey AS doc, CASE WHEN l_tax < 0.02 THEN 'accepted' WHEN l_tax < 0.05 THEN 'rejected' WHEN l_tax < 0.07 THEN 'review' END AS status, CASE l_returnflag WHEN 'A' THEN 'none' WHEN 'N' THEN 'visual_classification' END AS node, CASE WHEN l_quantity > 40 THEN 'too_faint' WHEN l_quantity > 30 THEN 'mostly_empty,too_faint' ELSE 'quality_ok' END AS reason FROM lineitem)
SELECT doc, count(*) FILTER (status = 'accepted') AS accepted_count, count(*) FILTER (status IS NULL OR status = 'review') AS review_count, count(*) FILTER (status = 'rejected') AS rejected_count, count(*) FILTER (node IS NULL OR node <> 'none') AS visual_classification_count, count(*) FILTER (node = 'none') AS none_count, count(*) FILTER (reason LIKE '%too_faint') AS faint FROM r GROUP BY doc""")
def refinement_summaries(t):
    i = F.col
    status = F.when(i("l_tax") < 0.02, "accepted").when(i("l_tax") < 0.05, "rejected").when(i("l_tax") < 0.07, "review")
    node = F.when(i("l_returnflag") == "A", "none").when(i("l_returnflag") == "N", "visual_classification")
    faults = F.when(i("l_quantity") > 40, F.array(F.lit("too_faint"))).when(i("l_quantity") > 30, F.array(F.lit("mostly_empty"), F.lit("too_faint"))).otherwise(F.array().cast("array<string>"))
    rows = t.lineitem.select(i("l_orderkey").alias("doc"), R.refiner_payload(status, i("l_discount"), faults, node).alias("p")).select("doc", "p.*").withColumn("faint", i("status_reason").endswith("too_faint"))
    faint = rows.groupBy("doc").agg(F.count_if("faint").alias("faint"))
    return R.refinement_summary(rows, "doc").join(faint, "doc")


@query("b32_evidence_policy", "SELECT DISTINCT p_type AS name, CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS importance, CASE p_size % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.55 ELSE 0.2 END::DOUBLE AS weight, CASE WHEN p_size % 3 = 0 THEN 'quadrants.' || p_size ELSE p_type END AS observed_path FROM part")
def evidence_policies(t):
    tier = F.when(F.col("p_size") % 4 == 0, "high").when(F.col("p_size") % 4 == 1, "medium").when(F.col("p_size") % 4 == 2, "other")
    fields = t.part.select(F.col("p_type").alias("name"), tier.alias("importance"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("quadrants."), F.col("p_size").cast("string"))).alias("observed_path")).distinct()
    return R.evidence_policy(fields).distinct()


@query("f22_case_metrics", "SELECT event_type AS label, event_id AS source, (event_id % 100) / 10.0 AS elapsed_seconds, 2::BIGINT AS feature_count, sha256('value=' || printf('%.6f', value) || '|user=' || printf('%.6f', user_id::DOUBLE)) AS vector_hash FROM events")
def case_metrics(t):
    started = F.col("ts").cast("timestamp")
    ended = F.timestamp_micros(F.unix_micros(started) + (F.col("event_id") % 100) * 100_000)
    cases = t.events.select(F.col("event_type").alias("label"), F.col("event_id").alias("source"), started.alias("started"), ended.alias("ended"), F.array(F.lit("value"), F.lit("user")).alias("names"), F.array(F.col("value"), F.col("user_id").cast("double")).alias("vector"))
    return R.case_metrics(cases)


@query("b22_active_features", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'reconstructed' ELSE 'original' END AS active_source, round(CASE WHEN event_id % 3 = 0 THEN value / 2 ELSE value END, 6) AS first FROM events")
def active_features(t):
    names = F.array(F.lit("a"), F.lit("b"))
    rows = t.events.select("event_id", names.alias("names"), F.array(F.col("value"), F.lit(1.0)).alias("vector"), F.when(F.col("event_id") % 3 == 0, "reconstructed").alias("source"), names.alias("selected_names"), F.array(F.col("value") / 2, F.lit(1.0)).alias("selected_vector"))
    return R.active_features(rows).select("event_id", "active_source", F.round(F.col("active_vector")[0], 6).alias("first"))


@query("m6_word_cuts", """WITH u AS (SELECT DISTINCT user_id AS unit FROM events), b AS (SELECT unit, i AS bin, ((unit * 7 + i * 13) % 20) / 20.0 AS a, ((unit + i * 3) % 10) / 40.0 AS g FROM u, unnest(range(0, 12)) r(i)),
s AS (SELECT unit, bin, greatest(0.0, a - g) AS score FROM b), p AS (SELECT s.*, unit % 5 AS expected FROM s WHERE score >= 0.35),
k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, bin) AS place FROM p)
SELECT u.unit, u.unit % 5 AS expected, 0.6::DOUBLE AS confidence, coalesce((SELECT array_to_string(list_sort(list(bin)), ',') FROM k WHERE k.unit = u.unit AND place <= greatest(0, expected - 1)), '') AS cuts FROM u""")
def word_cuts(t):
    """Cuts of units from invented scores of a sequence model's heads, neighbours allowed."""
    u = t.events.select(F.col("user_id").alias("unit")).distinct()
    bins = F.sequence(F.lit(0), F.lit(11))
    score = F.transform(bins, lambda i: (F.col("unit") * 7 + i * 13) % 20 / 20.0)
    bridge = F.transform(bins, lambda i: (F.col("unit") + i * 3) % 10 / 40.0)
    length = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(F.col("unit") % 5 == i, 0.6).otherwise(0.1))
    heads = u.select("unit", score.alias("boundary"), bridge.alias("bridge"), F.array_repeat(F.lit(1.0), 12).alias("safety"), length.alias("length"))
    return R.word_cuts(heads, min_distance=1).select("unit", F.col("expected").cast("bigint").alias("expected"), "confidence", F.array_join("cuts", ",").alias("cuts"))
