"""Rules, layout, splits and ranked choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import columns as C
from vellum.operators import joins, layout, rules, splits

from .registry import query

_SIGN = """s AS (SELECT p_partkey AS id, p_size % 4 AS loops, p_partkey % 7 AS endpoints, p_size % 6 AS junctions, p_partkey % 3 = 0 AS top_contact, p_partkey % 5 = 0 AS bottom_contact, (p_size % 20) / 10.0 AS aspect, (p_partkey % 10) / 10.0 AS horizontal, (p_partkey % 9) / 10.0 AS vertical, (p_partkey % 8) / 10.0 AS diagonal, (p_partkey % 6) / 10.0 AS curve, p_partkey % 4 AS phase, p_size % 2 = 0 AS line_removed, p_size % 3 = 0 AS bridge_required, p_partkey % 2 = 0 AS bridge_completed FROM part)"""
# the default rules once more, in SQL's words
_SAID = """sd AS (SELECT id, unnest(list_filter([
 CASE WHEN loops > 0 THEN 'family looped family_looped' END, CASE WHEN loops > 0 THEN 'has_structure loop family_looped' END, CASE WHEN loops < 1 THEN 'family no_loop family_no_loop' END,
 CASE WHEN loops > 1 THEN 'family multi_loop family_multi_loop' END, CASE WHEN loops > 1 THEN 'warning multi_loop_complexity family_multi_loop' END,
 CASE endpoints WHEN 0 THEN 'family closed_or_no_endpoint family_zero_endpoint' WHEN 1 THEN 'family single_endpoint family_single_endpoint' WHEN 2 THEN 'family two_endpoint family_two_endpoint' END,
 CASE endpoints WHEN 0 THEN 'warning zero_endpoints_check_skeleton family_zero_endpoint' WHEN 1 THEN 'warning single_endpoint_unusual family_single_endpoint' WHEN 2 THEN 'has_structure normal_path_exit_count family_two_endpoint' END,
 CASE WHEN endpoints > 4 THEN 'family many_endpoint family_many_endpoint' END, CASE WHEN endpoints > 4 THEN 'warning possible_fragmentation_or_noise family_many_endpoint' END,
 CASE WHEN junctions = 0 THEN 'family unbranched family_unbranched' ELSE 'family branched family_branched' END, CASE WHEN junctions > 0 THEN 'has_structure junction family_branched' END,
 CASE WHEN junctions > 3 THEN 'warning overbranched_check_artifact_or_bad_reconstruction warning_overbranched' END,
 CASE WHEN top_contact THEN 'family top_contact family_top_contact' END, CASE WHEN bottom_contact THEN 'family bottom_contact family_bottom_contact' END,
 CASE WHEN aspect >= 1.35 THEN 'family wide family_wide' WHEN aspect > 0.75 THEN 'family compact family_compact' WHEN aspect > 0 THEN 'family tall family_tall' END,
 CASE WHEN horizontal >= 0.45 THEN 'family horizontal_dominant family_horizontal_dominant' END, CASE WHEN vertical >= 0.45 THEN 'family vertical_dominant family_vertical_dominant' END,
 CASE WHEN diagonal >= 0.35 THEN 'family diagonal_rich family_diagonal_rich' END, CASE WHEN curve >= 0.35 THEN 'family curve_rich family_curve_rich' END,
 CASE WHEN phase >= 1 THEN 'history reconstructed history_reconstructed' END, CASE WHEN line_removed THEN 'history line_removal_applied history_line_removal' END,
 CASE WHEN bridge_required THEN CASE WHEN bridge_completed THEN 'history bridge_repair_completed history_completed_bridge' ELSE 'warning bridge_required_but_not_completed warning_unfinished_bridge' END END,
 CASE WHEN bridge_required AND NOT bridge_completed THEN 'selection_risk unsafe_reconstruction_candidate warning_unfinished_bridge' END,
 CASE WHEN loops > 0 AND junctions > 0 AND endpoints > 2 THEN 'family complex_loop_branch_endpoint combined_complex_loop_branch_endpoint' END
], lambda x: x IS NOT NULL)) AS said FROM s)"""
_FACTS = _SIGN + ", " + _SAID + ", r AS (SELECT id, split_part(said, ' ', 1) AS predicate, split_part(said, ' ', 2) AS argument, split_part(said, ' ', 3) AS origin FROM sd)"


def signatures(t) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    cols = {"loops": s % 4, "endpoints": k % 7, "junctions": s % 6, "top_contact": k % 3 == 0, "bottom_contact": k % 5 == 0, "aspect": s % 20 / 10.0, "horizontal": k % 10 / 10.0, "vertical": k % 9 / 10.0, "diagonal": k % 8 / 10.0, "curve": k % 6 / 10.0, "phase": k % 4, "line_removed": s % 2 == 0, "bridge_required": s % 3 == 0, "bridge_completed": k % 2 == 0}
    return t.part.select(k.alias("id"), *[v.alias(n) for n, v in cols.items()])


@query("r2_derived_facts", f"WITH {_FACTS} SELECT id, predicate, argument, 1.0::DOUBLE AS weight, string_agg(DISTINCT origin, '|' ORDER BY origin) AS origins FROM r GROUP BY id, predicate, argument")
def derived_facts(t):
    return rules.derive(signatures(t))


@query("r3_rule_fires", f"WITH {_FACTS} SELECT s.id, 2 * count(DISTINCT origin) AS fires, CASE WHEN count(origin) > 0 THEN 2 ELSE 1 END::BIGINT AS passes FROM s LEFT JOIN r USING (id) GROUP BY s.id")
def rule_fires(t):
    return rules.fired(signatures(t)).select("id", F.col("fires").cast("bigint").alias("fires"), F.col("passes").cast("bigint").alias("passes"))


#: Rules that read facts, in an order that takes several passes: the last one feeds the first.
CHAIN = [
    ("risky", "true", ["risk:high"], ["doubt:shape", "family:looped"]),
    ("doubtful", "endpoints >= 2", ["doubt:shape"], ["mark:odd"]),
    ("odd", "aspect >= 0.5", ["mark:odd"]),
    ("calm", "loops = 0", ["risk:none"]),
    ("looped", "loops >= 1", ["family:looped"]),
]


@query("r3_chained_facts", f"""WITH {_SIGN}, c AS (SELECT id, loops >= 1 AS l, endpoints >= 2 AS e, aspect >= 0.5 AS o FROM s)
SELECT id, array_to_string(list_sort(list_filter([CASE WHEN o THEN 'mark:odd' END, CASE WHEN o AND e THEN 'doubt:shape' END, CASE WHEN l THEN 'family:looped' ELSE 'risk:none' END, CASE WHEN o AND e AND l THEN 'risk:high' END], lambda x: x IS NOT NULL)), ' ') AS known,
CASE WHEN o AND e AND l THEN 4 WHEN o AND e THEN 3 ELSE 2 END::BIGINT AS passes,
CASE WHEN o AND e AND l THEN 4 + 4 + 3 + 2 WHEN o AND e THEN 3 + 3 + 2 WHEN o THEN 4 ELSE 2 END::BIGINT AS fires FROM c""")
def chained_facts(t):
    """A chain of rules over facts, to its fixpoint."""
    out = rules.chained(signatures(t), CHAIN)
    return out.select("id", F.array_join(F.array_sort("known"), " ").alias("known"), F.col("passes").cast("bigint").alias("passes"), F.col("fires").cast("bigint").alias("fires"))


@query("r1_fact_upsert", f"WITH {_FACTS}, u AS (SELECT id, predicate, argument, 1.0 AS w, origin FROM r UNION ALL SELECT id, predicate, argument, 0.5 + (id % 4) / 4.0, 'second' FROM r WHERE predicate = 'family') SELECT id, predicate, argument, max(w)::DOUBLE AS weight, string_agg(DISTINCT origin, '|' ORDER BY origin) AS origins FROM u GROUP BY id, predicate, argument")
def fact_upsert(t):
    """Facts stated again with another weight: the largest stays, origins add up."""
    first = rules.derive(signatures(t)).select("id", "predicate", "argument", "weight", F.explode(F.split("origins", r"\|")).alias("origin"))
    again = first.filter("predicate = 'family'").select("id", "predicate", "argument", (0.5 + F.col("id") % 4 / 4.0).cast("double").alias("weight"), F.lit("second").alias("origin"))
    return rules.upserted(first.unionByName(again))


_PROFILES = [("A", "required", "looped", 1.0), ("A", "boost", "wide", 0.8), ("B", "forbidden", "branched", 0.9), ("B", "weaken", "tall", 1.0), ("C", "boost", "no_loop", 0.4), ("C", "boost", "no_loop", 0.4)]


@query("r4_profile_effects", f"""WITH {_FACTS}, f AS (SELECT id, list(DISTINCT argument) FILTER (predicate = 'family') AS fam FROM r GROUP BY id), p(class, kind, family, weight) AS (VALUES {', '.join(str(p) for p in _PROFILES)}),
x AS (SELECT DISTINCT id, class, kind, family, weight, list_contains(fam, family) AS present FROM f, p) SELECT id, class, CASE WHEN kind IN ('required', 'forbidden') THEN 'block' ELSE kind END AS effect, round(CASE WHEN kind IN ('required', 'forbidden') THEN weight ELSE weight * 0.25 END, 6)::DOUBLE AS strength, kind || ':' || family AS reason FROM x WHERE CASE WHEN kind = 'required' THEN NOT present ELSE present END""")
def profile_effects(t):
    p = t.spark.createDataFrame(_PROFILES, "class string, kind string, family string, weight double")
    return rules.effects(rules.derive(signatures(t)), p).withColumn("strength", F.round("strength", 6))


@query("r5_explanations", f"WITH {_FACTS}, d AS (SELECT DISTINCT id, predicate || '(' || argument || ')' AS said FROM r) SELECT id, string_agg(said, '; ' ORDER BY said) AS explanation, count(*) AS facts FROM d GROUP BY id")
def explanations(t):
    return rules.explanation(rules.derive(signatures(t)))


def components(t) -> DataFrame:
    i = F.col
    x, y = i("l_partkey") * 13 % 900, i("l_suppkey") * 31 % 700
    w, h = i("l_quantity").cast("bigint") + 2, i("l_linenumber") * 4 + 3
    rows = t.lineitem.select(F.floor(i("l_orderkey") / 40).alias("doc"), i("l_returnflag").alias("layer"), (i("l_orderkey") * 8 + i("l_linenumber")).alias("id"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).cast("bigint").alias("y2"), (w * h / 3).cast("bigint").alias("ink"), (i("l_quantity") < 6).alias("small"), (w > 15 * h).alias("wide"))
    return joins.first_of(rows, ["doc", "id"], "x1", "y1", "layer", "ink", "small")


@query("r16_component_groups")
def component_groups(t):
    """Capped union-find over invented components; held against a plain loop in the tests."""
    return layout.component_groups(components(t))


@query("j9_line_buckets")
def line_buckets(t):
    return layout.line_buckets(components(t))


@query("r22_text_units")
def text_units(t):
    return layout.text_units(layout.line_buckets(components(t), keep=("x1", "x2")))


@query("j13_greedy_bin_matches")
def greedy_bin_matches(t):
    """Boundary bins of a user's clicks matched one to one with those of purchases."""
    e = t.events.filter("event_type in ('click', 'purchase')").select(F.col("user_id").alias("unit"), F.when(F.col("event_type") == "click", "a").otherwise("b").alias("side"), (F.col("event_id") % 64).alias("at")).distinct()
    return layout.greedy_matches(e, ["unit"], 2)


@query("o12_stratified_split", "SELECT l.quality AS class, count(*) AS sources, greatest(1, round_even(count(*) * 0.1, 0)::INT) AS test, greatest(1, round_even(count(*) * 0.1, 0)::INT) AS validation, 0 AS leaks FROM (SELECT DISTINCT doc_id, quality FROM labels) l GROUP BY 1")
def stratified_split(t):
    """Sources of each split by class, and how many sources stand in two splits (none)."""
    s = splits.stratified(t.labels.select(F.col("doc_id").alias("source"), F.col("quality").alias("class")).distinct())
    n = lambda v: F.countDistinct(F.when(F.col("split") == v, F.col("source"))).cast("int")
    leaks = s.groupBy("source").agg(F.countDistinct("split").alias("k")).filter("k > 1").agg(F.count("*").cast("int").alias("leaks"))
    return s.groupBy("class").agg(F.countDistinct("source").alias("sources"), n("test").alias("test"), n("validation").alias("validation")).withColumn("leaks", leaks.scalar())


@query("o13_word_pools", "SELECT count(DISTINCT text) AS texts, count(DISTINCT text) AS assigned, true AS whole FROM conversations")
def word_pools(t):
    """Every distinct text is in exactly one pool of the 80/10/10 split."""
    p = splits.pools(t.conversations.select("text", F.struct("conv_id", "turn").alias("seq")))
    return p.agg(F.countDistinct("text").alias("texts"), F.count("*").alias("assigned"), (F.count_if(F.col("split").isin("train", "validation", "test")) == F.count("*")).alias("whole"))


@query("o2_representatives", "SELECT l_returnflag AS class, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k = 1")
def representatives(t):
    return splits.representatives(t.lineitem.withColumn("class", F.col("l_returnflag")), ["class"], "l_orderkey", "l_linenumber", "l_partkey").select("class", "l_orderkey", "l_linenumber")


@query("o5_ranked_paths", "SELECT l_orderkey AS unit, l_linenumber AS path, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END, l_discount DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k <= 8")
def ranked_paths(t):
    """The eight best segmentation paths: priority, score, segments, id."""
    r = splits.best(t.lineitem, ["l_orderkey"], 8, F.when(F.col("l_linestatus") == "F", 0).otherwise(1), F.desc("l_discount"), "l_linenumber", "l_partkey", "l_suppkey")
    return r.select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("path"), F.col("place").cast("bigint").alias("place"))


@query("o6_ranked_hypotheses", "SELECT p_brand AS unit, p_partkey AS hypothesis FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END, p_size DESC, p_retailprice, p_partkey) AS k FROM part) WHERE k <= 5")
def ranked_hypotheses(t):
    tool = F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "STANDARD", 1).otherwise(2)
    return splits.best(t.part, ["p_brand"], 5, tool, F.desc("p_size"), "p_retailprice", "p_partkey").select(F.col("p_brand").alias("unit"), F.col("p_partkey").alias("hypothesis"))


@query("o9_distinct_in_order", "SELECT text, min(doc_id) AS first FROM documents GROUP BY text")
def distinct_in_order(t):
    return splits.distinct_in_order(t.documents.select("doc_id", "text"), ["text"], "doc_id").select("text", F.col("doc_id").alias("first"))


@query("o14_unique_names", "SELECT o_custkey, array_to_string(list_distinct(list(o_orderpriority)), '').length() > 0 AS any_name, count(DISTINCT o_orderpriority) AS names FROM orders GROUP BY 1")
def unique_names(t):
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]))
    return t.orders.groupBy("o_custkey").agg((F.length(F.array_join(names, "")) > 0).alias("any_name"), F.size(names).cast("bigint").alias("names"))


@query("w2_renumbered_groups", "WITH b AS (SELECT DISTINCT l_orderkey // 50 AS doc, l_returnflag AS layer, l_orderkey * 8 + l_linenumber AS id, l_partkey * 13 % 900 AS x1, l_suppkey * 31 % 700 AS y1 FROM lineitem) SELECT doc, layer, id, x1, y1, row_number() OVER (PARTITION BY doc, layer ORDER BY y1, x1, id) AS group_id, printf('%d_line%02d', id, row_number() OVER (PARTITION BY doc, layer ORDER BY y1, x1, id) % 3) AS child FROM b")
def renumbered_groups(t):
    i = F.col
    b = t.lineitem.select(F.floor(i("l_orderkey") / 50).alias("doc"), i("l_returnflag").alias("layer"), (i("l_orderkey") * 8 + i("l_linenumber")).alias("id"), (i("l_partkey") * 13 % 900).alias("x1"), (i("l_suppkey") * 31 % 700).alias("y1")).distinct()
    b = b.withColumn("group_id", rules.rank_in(["doc", "layer"], "y1", "x1", "id").cast("bigint"))
    return b.withColumn("child", F.format_string("%d_line%02d", "id", F.col("group_id") % 3))


@query("f12_width_penalties", "SELECT l_orderkey AS unit, l_linenumber AS segment, round(least(0.6, CASE WHEN r > 2.2 THEN 0.35 WHEN r > 1.6 THEN 0.18 ELSE 0 END + CASE WHEN r < 0.35 THEN 0.3 WHEN r < 0.55 THEN 0.12 ELSE 0 END + CASE WHEN l_tax > 0.06 THEN 0.1 ELSE 0 END), 6)::DOUBLE AS penalty, array_to_string(list_filter([CASE WHEN r > 1.6 THEN 'too_wide' END, CASE WHEN r < 0.55 THEN 'too_narrow' END, CASE WHEN l_tax > 0.06 THEN 'uncertain' END], lambda x: x IS NOT NULL), ',') AS reasons FROM (SELECT *, l_quantity / greatest(1.0, avg(l_quantity) OVER (PARTITION BY l_orderkey)) AS r FROM lineitem)")
def width_penalties(t):
    """Suspicion of a segment by its width against the unit's mean, capped, with reasons."""
    from pyspark.sql import Window

    r = F.col("l_quantity") / F.greatest(F.lit(1.0), F.avg("l_quantity").over(Window.partitionBy("l_orderkey")))
    rows = t.lineitem.withColumn("r", r)
    penalty = F.when(F.col("r") > 2.2, 0.35).when(F.col("r") > 1.6, 0.18).otherwise(0.0) + F.when(F.col("r") < 0.35, 0.3).when(F.col("r") < 0.55, 0.12).otherwise(0.0) + F.when(F.col("l_tax") > 0.06, 0.1).otherwise(0.0)
    reasons = F.array_compact(F.array(F.when(F.col("r") > 1.6, "too_wide"), F.when(F.col("r") < 0.55, "too_narrow"), F.when(F.col("l_tax") > 0.06, "uncertain")))
    return rows.select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("segment"), F.round(F.least(F.lit(0.6), penalty), 6).alias("penalty"), F.array_join(reasons, ",").alias("reasons"))


@query("f13_cut_scores", "SELECT l_orderkey AS unit, l_linenumber AS cut, round(0.55 * l_discount * 10 + 0.35 * (1 - l_tax) + 0.10 * (l_quantity / 50) - 0.05 * abs(l_linenumber - 4), 6)::DOUBLE AS score, round_even((l_quantity / 50) * 63, 0)::INT AS bin FROM lineitem")
def cut_scores(t):
    i = F.col
    score = 0.55 * i("l_discount") * 10 + 0.35 * (1 - i("l_tax")) + 0.10 * (i("l_quantity") / 50) - 0.05 * F.abs(i("l_linenumber") - 4)
    return t.lineitem.select(i("l_orderkey").alias("unit"), i("l_linenumber").alias("cut"), F.round(score, 6).alias("score"), F.bround(i("l_quantity") / 50 * 63).cast("int").alias("bin"))


@query("f23_expanded_boxes", "SELECT l_orderkey AS unit, l_linenumber AS line, greatest(0, x - greatest(3, w // 10)) AS x1, least(1000, x + w + greatest(3, w // 10)) AS x2 FROM (SELECT l_orderkey, l_linenumber, l_partkey * 13 % 900 AS x, l_quantity::BIGINT AS w FROM lineitem)")
def expanded_boxes(t):
    """Boxes grown by a tenth of their width, three pixels at least, within the page."""
    i = F.col
    x, w = i("l_partkey") * 13 % 900, i("l_quantity").cast("bigint")
    by = F.greatest(F.lit(3).cast("bigint"), F.floor(w / 10))
    b = C.padded(F.struct(x.alias("x1"), F.lit(0).alias("y1"), (x + w).alias("x2"), F.lit(1).alias("y2")), by, 1000, 1000)
    return t.lineitem.select(i("l_orderkey").alias("unit"), i("l_linenumber").alias("line"), b["x1"].alias("x1"), b["x2"].alias("x2"))


@query("b18_snapshot_deltas", "WITH b AS (SELECT l_returnflag AS k, l_linenumber AS f, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber < 6 GROUP BY ALL), a AS (SELECT l_returnflag AS k, l_linenumber AS f, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber > 2 GROUP BY ALL) SELECT coalesce(a.k, b.k) AS k, coalesce(a.f, b.f) AS f, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM a FULL JOIN b ON a.k = b.k AND a.f = b.f")
def snapshot_deltas(t):
    """Keyed differences over the union of two snapshots' keys; missing counts as 0."""
    def counted(rows, name):
        per = rows.groupBy(F.col("l_returnflag").alias("k"), F.col("l_linenumber").alias("f")).agg(F.count("*").alias("n"))
        return per.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("f", "n"))).alias(name))

    b, a = counted(t.lineitem.filter("l_linestatus = 'F' and l_linenumber < 6"), "b"), counted(t.lineitem.filter("l_linestatus = 'O' and l_linenumber > 2"), "a")
    zero = F.lit(0).cast("bigint")
    delta = F.map_zip_with("a", "b", lambda _, x, y: F.coalesce(x, zero) - F.coalesce(y, zero))
    return a.join(b, "k", "full_outer").select("k", F.explode(delta).alias("f", "delta"))


@query("b30_health_checks", "SELECT c_custkey AS document, CASE WHEN o.n IS NULL THEN 'FAIL' WHEN o.n < 5 THEN 'WARN' ELSE 'PASS' END AS status, coalesce(o.n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def health_checks(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("document")).agg(F.count("*").alias("n"))
    rows = t.customer.select(F.col("c_custkey").alias("document")).join(o, "document", "left")
    return rows.select("document", F.when(F.col("n").isNull(), "FAIL").when(F.col("n") < 5, "WARN").otherwise("PASS").alias("status"), F.coalesce("n", F.lit(0)).alias("orders"))


@query("b5_original_ranks", "WITH c AS (SELECT l_orderkey AS unit, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank, CASE WHEN l_quantity > 12 THEN l_returnflag || l_linestatus ELSE '' END AS text FROM lineitem) SELECT unit, arg_min(text, rank) AS best, min(rank) AS best_rank, count(*) AS kept FROM c WHERE text <> '' GROUP BY unit")
def original_ranks(t):
    """Non-empty candidates keep the rank they had among all; the first one is best."""
    text = F.when(F.col("l_quantity") > 12, F.concat("l_returnflag", "l_linestatus")).otherwise("")
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("unit")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", text.alias("text")))).alias("c"))
    ranked = F.filter(F.transform("c", lambda x, i: F.struct((i + 1).alias("rank"), x["text"].alias("text"))), lambda x: x["text"] != "")
    return rows.withColumn("k", ranked).filter(F.size("k") > 0).select("unit", F.col("k")[0]["text"].alias("best"), F.col("k")[0]["rank"].cast("bigint").alias("best_rank"), F.size("k").cast("bigint").alias("kept"))
