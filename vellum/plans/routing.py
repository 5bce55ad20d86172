"""Routing queries over invented crops: one per line item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import columns as C
from vellum.operators import routing as R

from .registry import query

_CROPS = """c AS (SELECT l_orderkey AS doc, l_linenumber AS crop, l_discount * 10 AS printed, l_tax * 12.5 AS handwriting, (l_quantity % 10) / 10 AS noise,
 CASE l_returnflag WHEN 'A' THEN 'blue' WHEN 'N' THEN 'black' ELSE CASE WHEN l_linenumber % 3 = 0 THEN 'violet' ELSE 'red' END END AS layer, l_partkey, l_suppkey, l_quantity FROM lineitem)"""
_CLASS = "CASE WHEN noise >= 0.65 AND NOT printed >= 0.45 AND NOT handwriting >= 0.45 THEN 'empty_or_noise' WHEN printed >= 0.45 AND handwriting >= 0.45 THEN 'mixed' {safety} WHEN printed >= 0.45 THEN 'printed_only' WHEN handwriting >= 0.45 THEN 'handwriting_only' ELSE 'review' END"
_SAFE = _CLASS.format(safety="WHEN printed >= 0.45 AND handwriting >= 0.25 THEN 'mixed'")


def crops(t) -> DataFrame:
    flag = F.col("l_returnflag")
    layer = F.when(flag == "A", "blue").when(flag == "N", "black").when(F.col("l_linenumber") % 3 == 0, "violet").otherwise("red")
    return t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("crop"), (F.col("l_discount") * 10).alias("printed"), (F.col("l_tax") * 12.5).alias("handwriting"), ((F.col("l_quantity") % 10) / 10).alias("noise"), layer.alias("layer"), "l_partkey", "l_suppkey", "l_quantity")


def classed(t) -> DataFrame:
    return crops(t).withColumn("visual", R.visual_class(F.col("printed"), F.col("handwriting"), F.col("noise")))


@query("p4_visual_classes", f"WITH {_CROPS} SELECT doc, crop, {_SAFE} AS visual, CASE {_SAFE} WHEN 'mixed' THEN 'printed_ocr,handwritten_ocr' WHEN 'printed_only' THEN 'printed_ocr' WHEN 'handwriting_only' THEN 'handwritten_ocr' WHEN 'empty_or_noise' THEN 'archive' ELSE 'review' END AS route FROM c")
def visual_classes(t):
    return classed(t).select("doc", "crop", "visual", F.array_join(R.route(F.col("visual")), ",").alias("route"))


@query("p1_p2_candidates", f"WITH {_CROPS}, v AS (SELECT *, {_SAFE} AS visual FROM c) SELECT doc, count(*) FILTER (visual IN ('printed_only', 'mixed')) AS printed, count(*) FILTER ((l_quantity > 48 OR visual IN ('handwriting_only', 'mixed')) AND layer IN ('blue', 'green', 'black', 'unknown_color')) AS handwritten FROM v GROUP BY doc")
def ocr_candidates(t):
    return classed(t).groupBy("doc").agg(F.count_if(R.to_printed(F.col("visual"))).alias("printed"), F.count_if(R.to_handwriting(F.col("visual"), F.col("layer"), F.col("l_quantity") > 48)).alias("handwritten"))


@query("p3_layers", "SELECT l_orderkey AS doc, l_linenumber AS crop, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE regexp_replace(CASE WHEN l_quantity > 25 THEN 'blue_ink_layer' ELSE 'red_continuity_mask' END, '_(ink_layer|continuity_mask|ink_mask)$', '') END AS layer FROM lineitem")
def layers(t):
    own = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise("")
    mask = F.when(F.col("l_quantity") > 25, "blue_ink_layer").otherwise("red_continuity_mask")
    return t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("crop"), R.layer_of(own, mask).alias("layer"))


_GRID = [(p, h, n) for p, h, n in [(0.3, 0.3, 0.5), (0.35, 0.35, 0.5), (0.4, 0.4, 0.5), (0.45, 0.45, 0.5), (0.45, 0.35, 0.5), (0.35, 0.45, 0.5), (0.5, 0.5, 0.5), (0.55, 0.55, 0.5), (0.6, 0.6, 0.5), (0.5, 0.4, 0.6), (0.4, 0.5, 0.6)]]
_GRID_SQL = "(0.3::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE), (0.35, 0.35, 0.5), (0.4, 0.4, 0.5), (0.45, 0.45, 0.5), (0.45, 0.35, 0.5), (0.35, 0.45, 0.5), (0.5, 0.5, 0.5), (0.55, 0.55, 0.5), (0.6, 0.6, 0.5), (0.5, 0.4, 0.6), (0.4, 0.5, 0.6)"


@query("a17_threshold_grid", f"""WITH {_CROPS}, g(p, h, n) AS (VALUES {_GRID_SQL}), r AS (SELECT p, h, n, {_SAFE} AS truth, CASE WHEN noise >= n AND NOT printed >= p AND NOT handwriting >= h THEN 'empty_or_noise' WHEN printed >= p AND handwriting >= h THEN 'mixed' WHEN printed >= p THEN 'printed_only' WHEN handwriting >= h THEN 'handwriting_only' ELSE 'review' END AS said FROM c, g)
SELECT p, h, n, truth, said, count(*) AS crops FROM r GROUP BY ALL""")
def threshold_grid(t):
    """Training-time classes under each of eleven threshold triples against the safe ones."""
    grid = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(h).alias("h"), F.lit(n).alias("n")) for p, h, n in _GRID])
    counts = classed(t).groupBy("printed", "handwriting", "noise", "visual").agg(F.count("*").alias("k"))  # few distinct scores: the grid multiplies these only
    rows = counts.select("*", F.explode(grid).alias("g")).select("*", "g.p", "g.h", "g.n")
    said = R.visual_class(F.col("printed"), F.col("handwriting"), F.col("noise"), {"printed": F.col("p"), "handwriting": F.col("h"), "noise": F.col("n")}, safety=False)
    return rows.groupBy("p", "h", "n", F.col("visual").alias("truth"), said.alias("said")).agg(F.sum("k").alias("crops"))


@query("p7_skip_reasons", f"WITH {_CROPS} SELECT layer, coalesce(CASE WHEN layer = 'red' THEN 'minos_not_required_by_n02_policy' WHEN l_quantity > 45 THEN 'rejected_by_refiner' WHEN l_suppkey % 17 = 0 THEN 'no_valid_minos_input_crop' END, 'processed') AS reason, count(*) AS n FROM c GROUP BY ALL")
def skip_reasons(t):
    rows = R.with_policy(crops(t))
    path = F.when(F.col("l_suppkey") % 17 != 0, F.lit("crop.png"))
    reason = R.skip_reason(F.col("required"), F.when(F.col("l_quantity") > 45, "rejected").otherwise("ok"), path)
    return rows.groupBy("layer", F.coalesce(reason, F.lit("processed")).alias("reason")).agg(F.count("*").alias("n"))


# the policies once more, in SQL's words
_POLICY_SQL = """('blue', 'probable_handwriting', 'probable_handwriting', 'N05_handwritten_ocr', true, 'handwriting_audit', true, false), ('green', 'probable_handwriting', 'probable_handwriting', 'N05_handwritten_ocr', true, 'handwriting_audit', true, false),
('red', 'probable_markup_or_correction', 'correction_markup', 'N06_correction_resolver', false, 'skip_markup_evidence', false, true), ('black', 'dark_ink_unknown_role', 'dark_ink_needs_visual_routing', 'N03_visual_classification_router', true, 'primary_router', true, false),
('unknown_color', 'ambiguous_colored_ink', 'unknown_colored_ink', 'N03_visual_classification_router', true, 'fallback_router', true, false)"""


@query("p10_layer_policies", f"""WITH {_CROPS}, p(layer, hypothesis, role, next_node, required, mode, candidate, evidence) AS (VALUES {_POLICY_SQL})
SELECT c.layer, coalesce(hypothesis, 'unknown_layer') AS hypothesis, coalesce(role, 'review') AS role, coalesce(next_node, 'review') AS next_node, coalesce(required, true) AS required, coalesce(mode, 'fallback_router') AS mode, coalesce(candidate, true) AS candidate, coalesce(evidence, false) AS evidence, count(*) AS crops, count(DISTINCT doc) AS docs FROM c LEFT JOIN p USING (layer) GROUP BY ALL""")
def layer_policies(t):
    keys = ["layer", "hypothesis", "role", "next_node", "required", "mode", "candidate", "evidence"]
    return R.with_policy(crops(t)).groupBy(*keys).agg(F.count("*").alias("crops"), F.countDistinct("doc").alias("docs"))


@query("p11_layer_groups", f"WITH {_CROPS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc, layer ORDER BY crop, l_partkey, l_suppkey, l_quantity, printed, handwriting) AS k FROM c) SELECT doc, layer, crop, printf('%s_%04d', layer, k) AS uid FROM r")
def layer_groups(t):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("doc", "layer").orderBy("crop", "l_partkey", "l_suppkey", "l_quantity", "printed", "handwriting"))
    return crops(t).withColumn("k", k).select("doc", "layer", "crop", F.format_string("%s_%04d", "layer", "k").alias("uid"))


_DIMS = "(l_partkey % 380)::BIGINT AS w, (l_suppkey % 130)::BIGINT AS h, round_even((l_quantity * 2) / 100, 4) AS d, l_linenumber % 4 AS n"
_REJECT = """CASE WHEN w > 350 OR h > 122 OR w * h > 34000 THEN 'oversized_group' WHEN w >= 18 AND h <= 10 AND w / greatest(h, 1) >= 5 THEN 'horizontal_line_like_group' WHEN h >= 18 AND w <= 10 AND h / greatest(w, 1) >= 4 THEN 'vertical_line_like_group'
WHEN w * h <= 60 AND w <= 10 AND h <= 10 THEN 'tiny_isolated_group' WHEN w * h <= 200 AND d >= 0.8 THEN 'small_dense_blob' WHEN w <= 18 AND h <= 18 AND w * h <= 260 AND d >= 0.5 AND w / greatest(h, 1) BETWEEN 0.7 AND 1.45 AND n <= 2 THEN 'small_dense_square_blob'
WHEN w BETWEEN 24 AND 40 AND h BETWEEN 20 AND 36 AND w * h <= 1300 AND d BETWEEN 0.08 AND 0.25 AND w / greatest(h, 1) BETWEEN 0.8 AND 1.5 AND n <= 3 THEN 'small_hollow_square_blob' END"""


@query("p9_line_filter", f"WITH g AS (SELECT l_orderkey AS doc, l_linenumber AS line, l_partkey, l_suppkey, {_DIMS} FROM lineitem), r AS (SELECT *, {_REJECT} AS reason FROM g) SELECT doc, line, l_partkey, l_suppkey, reason, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY doc, reason IS NULL ORDER BY line, l_partkey, l_suppkey) END AS group_id FROM r")
def line_filter(t):
    from pyspark.sql import Window

    g = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey", (F.col("l_partkey") % 380).alias("w"), (F.col("l_suppkey") % 130).alias("h"), F.bround(F.col("l_quantity") * 2 / 100, 4).alias("d"), (F.col("l_linenumber") % 4).alias("n"))
    g = g.withColumn("reason", R.reject_reason(F.col("w"), F.col("h"), F.col("d"), F.col("n")))
    k = F.row_number().over(Window.partitionBy("doc", F.col("reason").isNull()).orderBy("line", "l_partkey", "l_suppkey"))
    return g.select("doc", "line", "l_partkey", "l_suppkey", "reason", F.when(F.col("reason").isNull(), k.cast("bigint")).alias("group_id"))


_BOX = "l_partkey % 500 AS a, l_suppkey * 7 % 700 AS b, l_partkey % 500 + l_quantity::BIGINT - 10 AS c, l_suppkey * 7 % 700 + l_linenumber * 6 AS d"


@query("p12_p13_boxes", f"""WITH r AS (SELECT l_orderkey AS doc, l_linenumber AS line, {_BOX} FROM lineitem), n AS (SELECT doc, line, least(a, c) AS x1, least(b, d) AS y1, greatest(a, c) AS x2, greatest(b, d) AS y2 FROM r)
SELECT doc, line, greatest(0, x1 - 4) AS x1, greatest(0, y1 - 4) AS y1, least(512, x2 + 4) AS x2, least(720, y2 + 4) AS y2, greatest(0, x2 - x1) * greatest(0, y2 - y1) AS area,
 greatest(0, least(x2, 300) - greatest(x1, 200)) * greatest(0, least(y2, 400) - greatest(y1, 300)) AS shared,
 round(sqrt((greatest(0, greatest(x1, 200) - least(x2, 300)) ** 2 + greatest(0, greatest(y1, 300) - least(y2, 400)) ** 2)::DOUBLE), 6) AS distance,
 round(greatest(0, least(y2, 400) - greatest(y1, 300)) / greatest(1, least(y2 - y1, 100)), 6) AS vertical, round(greatest(y2 - y1, 100) / greatest(1, least(y2 - y1, 100)), 6) AS ratio FROM n""")
def boxes(t):
    i = F.col
    b = C.box(i("l_partkey") % 500, i("l_suppkey") * 7 % 700, i("l_partkey") % 500 + i("l_quantity").cast("bigint") - 10, i("l_suppkey") * 7 % 700 + i("l_linenumber") * 6)
    fixed = C.box(F.lit(200).cast("bigint"), F.lit(300).cast("bigint"), F.lit(300).cast("bigint"), F.lit(400).cast("bigint"))
    rows = t.lineitem.select(i("l_orderkey").alias("doc"), i("l_linenumber").alias("line"), b.alias("b"), fixed.alias("f"))
    b, f = F.col("b"), F.col("f")
    return rows.select("doc", "line", C.padded(b, 4, 512, 720).alias("p"), C.area(b).alias("area"), C.overlap(b, f).alias("shared"), F.round(C.distance(b, f), 6).alias("distance"), F.round(C.vertical_overlap(b, f), 6).alias("vertical"), F.round(C.height_ratio(b, f), 6).alias("ratio")).select("doc", "line", "p.*", "area", "shared", "distance", "vertical", "ratio")


@query("p14_best_sources", "SELECT source, count(*) AS n, count(DISTINCT value) AS values FROM (SELECT CASE WHEN l_quantity > 40 THEN 'context' WHEN l_discount > 0.05 THEN 'black' WHEN l_tax > 0.02 THEN 'crop' END AS source, CASE WHEN l_quantity > 40 THEN 'c' || l_partkey WHEN l_discount > 0.05 THEN 'b' || l_suppkey WHEN l_tax > 0.02 THEN l_returnflag END AS value FROM lineitem) GROUP BY source")
def best_sources(t):
    i = F.col
    best = C.first_of(("context", F.when(i("l_quantity") > 40, F.concat(F.lit("c"), i("l_partkey")))), ("black", F.when(i("l_discount") > 0.05, F.concat(F.lit("b"), i("l_suppkey"))).otherwise("")), ("crop", F.when(i("l_tax") > 0.02, i("l_returnflag"))))
    return t.lineitem.select(best.alias("b")).groupBy("b.source").agg(F.count("*").alias("n"), F.countDistinct("b.value").alias("values"))


@query("p16_conditions", """WITH r AS (SELECT p_partkey AS unit, p_size % 3 AS a, p_partkey % 6 AS b, p_size % 5 - 3 AS c, p_partkey % 2 AS d FROM part),
n AS (SELECT unit, list_filter([CASE WHEN a > 1 THEN 'multiple_components' END, CASE WHEN b >= 4 THEN 'many_endpoints' END, CASE WHEN c > 0 THEN 'isolated_points' END, CASE WHEN d > 0 THEN 'short_paths' END], lambda x: x IS NOT NULL) AS notes FROM r)
SELECT unit, CASE WHEN len(notes) > 0 THEN 'uncertain' ELSE 'clean' END AS condition, CASE WHEN len(notes) > 0 THEN 'unknown' ELSE 'clean' END AS damage, CASE WHEN len(notes) > 0 THEN 0.35 ELSE 0.8 END::DOUBLE AS confidence, round(least(1.0, 0.15 * len(notes)), 6)::DOUBLE AS severity, CASE WHEN len(notes) > 0 THEN array_to_string(notes, ',') ELSE 'no_strong_damage_signal' END AS notes FROM n""")
def conditions(t):
    i = F.col
    rows = t.part.select(i("p_partkey").alias("unit"), R.condition(i("p_size") % 3, i("p_partkey") % 6, i("p_size") % 5 - 3, i("p_partkey") % 2).alias("v"))
    return rows.select("unit", "v.condition", "v.damage", F.col("v.confidence").cast("double").alias("confidence"), F.round(F.col("v.severity").cast("double"), 6).alias("severity"), F.array_join("v.notes", ",").alias("notes"))


_DAMAGES = sorted({*R.REPAIRS, *R.EXPERTS, "unknown"})
_DAMAGE_SQL = ", ".join("(" + ", ".join([str(k), f"'{d}'", f"'{','.join(R.REPAIRS.get(d, []))}'", *map(str, R.EXPERTS.get(d, R.EXPERTS["clean"]))]) + ")" for k, d in enumerate(_DAMAGES))


@query("p15_repair_routes", f"""WITH d(k, damage, repairs, trace, glyph, shape, context) AS (VALUES {_DAMAGE_SQL}), r AS (SELECT p_partkey AS unit, damage, repairs, trace, glyph, shape, context, (p_size % 20) / 20.0 AS confidence, CASE WHEN damage = 'clean' THEN 'clean' ELSE 'damaged' END AS condition FROM part JOIN d ON p_partkey % {len(_DAMAGES)} = k)
SELECT unit, damage, repairs, trace::DOUBLE AS trace, glyph::DOUBLE AS glyph, shape::DOUBLE AS shape, context::DOUBLE AS context, damage IN ('ink_overlap', 'stamp_interference') OR (confidence < 0.45 AND damage <> 'clean') AS manual_review, CASE WHEN confidence < 0.45 AND damage <> 'clean' THEN 'low_confidence_' ELSE '' END || 'route_for_' || damage AS reason FROM r""")
def repair_routes(t):
    damage = F.element_at(F.array(*map(F.lit, _DAMAGES)), (F.col("p_partkey") % len(_DAMAGES) + 1).cast("int"))
    rows = t.part.select(F.col("p_partkey").alias("unit"), damage.alias("damage"), (F.col("p_size") % 20 / 20.0).alias("confidence")).withColumn("condition", F.when(F.col("damage") == "clean", "clean").otherwise("damaged"))
    return R.with_repairs(rows).select("unit", "damage", F.array_join("repairs", ",").alias("repairs"), "trace", "glyph", "shape", "context", "manual_review", "reason")


@query("p18_decision_statuses", "WITH r AS (SELECT l_orderkey AS token, string_agg(CASE WHEN l_quantity > 10 THEN l_returnflag END, '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS text, round(avg(l_discount * 10), 9) AS score, count(*) FILTER (l_quantity > 10) AS populated, count(*) AS positions FROM lineitem GROUP BY l_orderkey) SELECT token, CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN populated / greatest(1, positions) < 0.7 THEN 'weak_low_coverage' WHEN score < 0.42 THEN 'weak_low_score' ELSE 'provisional_ready' END AS status FROM r")
def decision_statuses(t):
    q = F.col("l_quantity") > 10
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(q, F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")))), lambda x: x["l_returnflag"]), "")
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("token")).agg(text.alias("text"), F.round(F.avg(F.col("l_discount") * 10), 9).alias("score"), F.count_if(q).alias("populated"), F.count("*").alias("positions"))
    return rows.select("token", R.decision_status(F.col("text"), F.col("score"), F.col("populated"), F.col("positions")).alias("status"))


@query("p19_matrix_statuses", "SELECT o_custkey AS document, CASE WHEN bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O') THEN 'completed_with_gaps' WHEN bool_or(o_orderstatus = 'F') THEN 'completed' WHEN bool_or(o_orderstatus = 'P') THEN 'partial' ELSE 'empty' END AS status, count(*) AS units FROM orders GROUP BY o_custkey")
def matrix_statuses(t):
    any_ = lambda s: F.bool_or(F.col("o_orderstatus") == s)
    status = F.when(any_("F") & any_("O"), "completed_with_gaps").when(any_("F"), "completed").when(any_("P"), "partial").otherwise("empty")
    return t.orders.groupBy(F.col("o_custkey").alias("document")).agg(status.alias("status"), F.count("*").alias("units"))


@query("a1_route_summary", f"WITH {_CROPS}, v AS (SELECT *, {_SAFE} AS visual FROM c) SELECT layer, count(*) AS crops, count(*) FILTER (visual = 'mixed') AS mixed, count(*) FILTER (visual = 'printed_only') AS printed_only, count(*) FILTER (visual = 'handwriting_only') AS handwriting_only, count(*) FILTER (visual = 'empty_or_noise') AS noise, count(*) FILTER (visual = 'review') AS review FROM v GROUP BY layer")
def route_summary(t):
    n = lambda v: F.count_if(F.col("visual") == v)
    return classed(t).groupBy("layer").agg(F.count("*").alias("crops"), n("mixed").alias("mixed"), n("printed_only").alias("printed_only"), n("handwriting_only").alias("handwriting_only"), n("empty_or_noise").alias("noise"), n("review").alias("review"))


@query("a21_assembly_summary", "WITH u AS (SELECT l_orderkey AS unit, count(*) AS paths, count(*) FILTER (l_linestatus = 'F') AS selected, max(l_quantity) AS widest FROM lineitem GROUP BY 1) SELECT unit % 12 AS bucket, count(*) AS units, sum(paths)::BIGINT AS paths, max(paths) AS most, count(*) FILTER (selected > 0) AS with_selection, max(widest) AS widest FROM u GROUP BY 1")
def assembly_summary(t):
    u = t.lineitem.groupBy(F.col("l_orderkey").alias("unit")).agg(F.count("*").alias("paths"), F.count_if(F.col("l_linestatus") == "F").alias("selected"), F.max("l_quantity").alias("widest"))
    return u.groupBy((F.col("unit") % 12).alias("bucket")).agg(F.count("*").alias("units"), F.sum("paths").alias("paths"), F.max("paths").alias("most"), F.count_if(F.col("selected") > 0).alias("with_selection"), F.max("widest").alias("widest"))


@query("f17_safe_casts", r"""SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(try_cast(event_type AS DOUBLE), -1.0) AS number, lower(trim(CASE WHEN event_id % 3 = 0 THEN ' Yes' ELSE event_type END)) IN ('1', 'true', 'yes', 'on') AS flag, coalesce(json_extract_string(props, '$.label'), json_extract_string(props, '$.k')) AS label FROM events""")
def safe_casts(t):
    k = F.get_json_object("props", "$.k")
    flag = F.when(F.col("event_id") % 3 == 0, " Yes").otherwise(F.col("event_type"))
    return t.events.select("event_id", C.as_int(k).alias("k"), C.as_float(F.col("event_type"), -1.0).alias("number"), C.as_bool(flag).alias("flag"), F.coalesce(F.get_json_object("props", "$.label"), k).alias("label"))
