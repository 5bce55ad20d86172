"""Joins over orders, line items, events and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import columns as C
from vellum.operators import joins as J

from .registry import query


@query("j1_left_last_duplicate", "WITH s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS k FROM lineitem) SELECT o_orderkey AS unit, l_partkey AS path, coalesce(l_linestatus, 'missing') AS status FROM orders LEFT JOIN s ON o_orderkey = l_orderkey AND k = 1")
def left_last_duplicate(t):
    right = t.lineitem.select(F.col("l_orderkey").alias("unit"), "l_partkey", "l_linestatus", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("seq"))
    out = J.left_last(t.orders.select(F.col("o_orderkey").alias("unit")), right, ["unit"], "seq")
    return out.select("unit", F.col("l_partkey").alias("path"), F.coalesce("l_linestatus", F.lit("missing")).alias("status"))


@query("j2_coalesced_key_overlay", "WITH d AS (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS token, o_orderkey AS unit, o_totalprice FROM orders), c AS (SELECT l_orderkey AS key, count(*) AS positions, avg(l_discount) AS score FROM lineitem GROUP BY 1) SELECT coalesce(token, unit) AS key, o_totalprice, coalesce(positions, 0) AS positions, round(coalesce(score, 0), 9) AS score FROM d LEFT JOIN c ON coalesce(token, unit) = key")
def coalesced_key_overlay(t):
    d = t.orders.select(F.coalesce(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")), F.col("o_orderkey")).alias("key"), "o_totalprice")
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("positions"), F.avg("l_discount").alias("score"))
    return d.join(c, "key", "left").select("key", "o_totalprice", F.coalesce("positions", F.lit(0)).alias("positions"), F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))


_SEG = "l_partkey % 40 AS path, l_linenumber AS segment, l_orderkey AS unit, l_suppkey"


@query("j3_expert_job_queue", f"WITH s AS (SELECT {_SEG} FROM lineitem), c AS (SELECT path, segment, damage FROM (SELECT l_partkey % 40 AS path, l_linenumber AS segment, CASE WHEN l_quantity > 30 THEN 'light_cut' ELSE 'clean' END AS damage, row_number() OVER (PARTITION BY l_partkey % 40, l_linenumber ORDER BY l_orderkey DESC, l_partkey DESC, l_suppkey DESC) AS k FROM lineitem) WHERE k = 1) SELECT path, segment, coalesce(damage, 'clean') AS damage, count(*) AS jobs, count(DISTINCT unit) AS units FROM s LEFT JOIN c USING (path, segment) GROUP BY ALL")
def expert_job_queue(t):
    """Segments with the condition of their path and segment; the last unit's wins, as ids aren't unique across units."""
    s = t.lineitem.select((F.col("l_partkey") % 40).alias("path"), F.col("l_linenumber").alias("segment"), F.col("l_orderkey").alias("unit"), F.when(F.col("l_quantity") > 30, "light_cut").otherwise("clean").alias("damage"), F.struct("l_orderkey", "l_partkey", "l_suppkey").alias("seq"))
    out = J.left_last(s.select("path", "segment", "unit"), s.select("path", "segment", "damage", "seq"), ["path", "segment"], "seq")
    return out.groupBy("path", "segment", F.coalesce("damage", F.lit("clean")).alias("damage")).agg(F.count("*").alias("jobs"), F.countDistinct("unit").alias("units"))


@query("j4_carried_results", "WITH n AS (SELECT l_orderkey AS unit, l_partkey AS path, l_linenumber AS segment FROM lineitem), o AS (SELECT DISTINCT l_orderkey AS unit, l_partkey AS path, l_linenumber AS segment FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01') SELECT n.unit, count(*) AS jobs, count(o.unit) AS carried FROM n LEFT JOIN o USING (unit, path, segment) GROUP BY n.unit")
def carried_results(t):
    n = t.lineitem.select(F.col("l_orderkey").alias("unit"), F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("segment"), "l_shipdate")
    o = n.filter(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")).select("unit", "path", "segment").distinct().withColumn("done", F.lit(1))
    return n.join(o, ["unit", "path", "segment"], "left").groupBy("unit").agg(F.count("*").alias("jobs"), F.count("done").alias("carried"))


_ALIGN = r"""WITH a AS (SELECT c_custkey AS token, c_mktsegment AS truth, CASE WHEN c_custkey % 3 = 0 THEN substr(c_mktsegment, 2) WHEN c_custkey % 3 = 1 THEN c_mktsegment || 'S' ELSE c_mktsegment END AS said FROM customer)
SELECT token, i - 1 AS position, substr(truth, i::INT, 1) AS truth, substr(said, i::INT, 1) AS said FROM a, unnest(range(1, greatest(length(truth), length(said)) + 1)) t(i)"""


@query("j5_truth_alignment", _ALIGN)
def truth_alignment(t):
    """Truth and prediction letter by letter; the shorter one is padded with empty text."""
    s = F.col("c_mktsegment")
    a = t.customer.select(F.col("c_custkey").alias("token"), s.alias("truth"), F.when(F.col("c_custkey") % 3 == 0, F.substr(s, F.lit(2))).when(F.col("c_custkey") % 3 == 1, F.concat(s, F.lit("S"))).otherwise(s).alias("said"))
    i = F.explode(F.sequence(F.lit(1), F.greatest(F.length("truth"), F.length("said")))).alias("i")
    return a.select("token", "truth", "said", i).select("token", (F.col("i") - 1).cast("bigint").alias("position"), F.substring(F.col("truth"), F.col("i"), F.lit(1)).alias("truth"), F.substring(F.col("said"), F.col("i"), F.lit(1)).alias("said"))


_BOX = "l_orderkey // 50 AS doc, l_orderkey * 8 + l_linenumber AS id, l_partkey * 13 % 900 AS x1, l_suppkey * 31 % 700 AS y1, l_partkey * 13 % 900 + l_quantity::BIGINT AS x2, l_suppkey * 31 % 700 + l_linenumber * 4 AS y2, l_returnflag AS layer"


def boxes(t):
    i = F.col
    x, y = i("l_partkey") * 13 % 900, i("l_suppkey") * 31 % 700
    return t.lineitem.select(F.floor(i("l_orderkey") / 50).alias("doc"), (i("l_orderkey") * 8 + i("l_linenumber")).alias("id"), C.box(x, y, x + i("l_quantity").cast("bigint"), y + i("l_linenumber") * 4).alias("box"), i("l_returnflag").alias("layer")).distinct()


_SPATIAL = f"""b AS (SELECT DISTINCT {_BOX} FROM lineitem),
x AS (SELECT a.doc, a.id AS id_a, r.id AS id_b FROM b a JOIN b r ON a.doc = r.doc AND a.layer = 'A' AND r.layer = 'R' AND least(a.x2, r.x2) > greatest(a.x1, r.x1) AND least(a.y2, r.y2) > greatest(a.y1, r.y1)),
d AS (SELECT doc, id_a, count(*) AS crossings FROM x GROUP BY ALL),
o AS (SELECT * FROM b WHERE layer = 'R' AND (doc, id) NOT IN (SELECT doc, id_b FROM x)),
n AS (SELECT a.doc, a.id AS id_a, o.id AS id_b, sqrt((greatest(0, greatest(a.x1, o.x1) - least(a.x2, o.x2)) ** 2 + greatest(0, greatest(a.y1, o.y1) - least(a.y2, o.y2)) ** 2)::DOUBLE) AS distance, (o.x2 - o.x1) * (o.y2 - o.y1) AS area FROM b a JOIN d ON a.doc = d.doc AND a.id = d.id_a AND a.layer = 'A' JOIN o ON a.doc = o.doc),
k AS (SELECT *, row_number() OVER (PARTITION BY doc, id_a ORDER BY round(distance, 4), area DESC, id_b) AS rank FROM n WHERE distance <= 55)"""


def _pair_sides(t):
    b = boxes(t)
    return b.filter("layer = 'A'").select("doc", F.col("id").alias("id_a"), F.col("box").alias("a")), b.filter("layer = 'R'").select("doc", F.col("id").alias("id_b"), F.col("box").alias("b"))


@query("j7_correction_routing", f"WITH {_SPATIAL} SELECT doc, id_a, id_b, rank, round(distance, 4) AS distance FROM k WHERE rank <= 3")
def correction_routing(t):
    _, found = J.corrections(*_pair_sides(t))
    return found.select("doc", "id_a", "id_b", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 4).alias("distance"))


@query("j7_crossed_boxes", f"WITH {_SPATIAL} SELECT doc, id_a, crossings FROM d")
def crossed_boxes(t):
    return J.corrections(*_pair_sides(t))[0]


@query("j12_best_overlaps", f"""WITH {_SPATIAL}, s AS (SELECT a.doc, a.id AS id_a, r.id AS id_b, greatest(0, least(a.x2, r.x2) - greatest(a.x1, r.x1)) * greatest(0, least(a.y2, r.y2) - greatest(a.y1, r.y1)) / greatest(1, least((a.x2 - a.x1) * (a.y2 - a.y1), (r.x2 - r.x1) * (r.y2 - r.y1))) AS share FROM b a JOIN b r ON a.doc = r.doc AND a.layer = 'A' AND r.layer = 'R'),
m AS (SELECT *, row_number() OVER (PARTITION BY doc, id_a ORDER BY share DESC, id_b) AS k FROM s WHERE share >= 0.25) SELECT doc, id_a, id_b, round(share, 6) AS share FROM m WHERE k = 1""")
def best_overlaps(t):
    return J.best_overlaps(*_pair_sides(t), ["doc"]).withColumn("share", F.round("share", 6))


_CONNECT = f"""WITH b AS (SELECT DISTINCT {_BOX} FROM lineitem), p AS (SELECT a.doc, a.id AS id_a, c.id AS id_b FROM b a JOIN b c ON a.doc = c.doc AND a.layer = c.layer AND a.id <> c.id AND c.x1 >= a.x1 AND c.x1 - a.x2 <= 45 AND c.x1 - a.x2 >= -greatest(a.x2 - a.x1, c.x2 - c.x1)
 AND abs((a.y1 + a.y2) / 2 - (c.y1 + c.y2) / 2) <= 22 AND greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) / greatest(1, least(a.y2 - a.y1, c.y2 - c.y1)) >= 0.18 AND greatest(a.y2 - a.y1, c.y2 - c.y1) / greatest(1, least(a.y2 - a.y1, c.y2 - c.y1)) <= 3.7)
SELECT doc, id_a, id_b FROM p"""


@query("j8_connected_pairs", _CONNECT)
def connected_pairs(t):
    """Pairs of one layer that stand on one line, close and of like height."""
    b = boxes(t)
    left, right = b.select("doc", "layer", F.col("id").alias("id_a"), F.col("box").alias("a")), b.select("doc", "layer", F.col("id").alias("id_b"), F.col("box").alias("b"))
    a, c = F.col("a"), F.col("b")
    gap, middle = c["x1"] - a["x2"], lambda x: (x["y1"] + x["y2"]) / 2
    good = (F.col("id_a") != F.col("id_b")) & (c["x1"] >= a["x1"]) & (gap <= 45) & (gap >= -F.greatest(a["x2"] - a["x1"], c["x2"] - c["x1"])) & (F.abs(middle(a) - middle(c)) <= 22) & (C.vertical_overlap(a, c) >= 0.18) & (C.height_ratio(a, c) <= 3.7)
    return J.near(left, right, ["doc", "layer"], 45).filter(good).select("doc", "id_a", "id_b")


@query("j11_boundary_alignment", """WITH b AS (SELECT DISTINCT user_id AS unit, event_id % 64 AS bin FROM events WHERE event_type <> 'click'), h AS (SELECT user_id AS unit, event_id % 64 AS hint, max(value) AS probability FROM events WHERE event_type = 'click' GROUP BY ALL),
m AS (SELECT b.unit, b.bin, h.probability, h.hint, row_number() OVER (PARTITION BY b.unit, b.bin ORDER BY h.probability DESC, h.hint) AS k FROM b LEFT JOIN h ON b.unit = h.unit AND abs(b.bin - h.hint) <= 1) SELECT unit, bin, probability, hint FROM m WHERE k = 1""")
def boundary_alignment(t):
    b = t.events.filter("event_type <> 'click'").select(F.col("user_id").alias("unit"), (F.col("event_id") % 64).alias("bin")).distinct()
    h = t.events.filter("event_type = 'click'").groupBy(F.col("user_id").alias("unit"), (F.col("event_id") % 64).alias("hint")).agg(F.max("value").alias("probability"))
    return J.aligned(b, h)


_TREE = "SELECT o_custkey AS folder, o_orderpriority AS name, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS digest FROM orders WHERE {} GROUP BY ALL"


@query("j15_tree_difference", f"WITH a AS ({_TREE.format('o_orderkey % 3 <> 0')}), b AS ({_TREE.format('o_orderkey % 3 <> 1 OR o_custkey % 2 = 0')}) SELECT folder, name, CASE WHEN a.digest IS NULL THEN 'added' WHEN b.digest IS NULL THEN 'removed' WHEN a.digest <> b.digest THEN 'changed' ELSE 'unchanged' END AS status FROM a FULL JOIN b USING (folder, name)")
def tree_difference(t):
    def tree(rows):
        return rows.groupBy(F.col("o_custkey").alias("folder"), F.col("o_orderpriority").alias("name")).agg(F.md5(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",")).alias("digest"))

    return J.tree_difference(tree(t.orders.filter("o_orderkey % 3 <> 0")), tree(t.orders.filter("o_orderkey % 3 <> 1 or o_custkey % 2 = 0")), ["folder", "name"], "digest").select("folder", "name", "status")


@query("o9_o11_set_operations", "WITH a AS (SELECT DISTINCT l_suppkey % 70 AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT s_suppkey AS k FROM supplier) SELECT 'union' AS kind, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)")
def set_operations(t):
    a, b = t.lineitem.filter("l_returnflag = 'A'").select((F.col("l_suppkey") % 70).alias("k")), t.supplier.select(F.col("s_suppkey").alias("k"))
    named = lambda n, df: df.select(F.lit(n).alias("kind"), "k")
    return named("union", a.union(b).distinct()).union(named("except", b.subtract(a))).union(named("intersect", a.intersect(b)))


@query("j17_baseline_difference", "WITH r AS (SELECT l_returnflag || l_linestatus || l_linenumber AS class, l_shipdate < TIMESTAMP '1998-06-01' AS old, count(*) AS n, max(l_quantity) AS widest, round(sum(l_tax), 6) AS seconds FROM lineitem GROUP BY ALL) SELECT a.class, array_to_string(list_filter([CASE WHEN a.n IS DISTINCT FROM b.n THEN 'n' END, CASE WHEN a.widest IS DISTINCT FROM b.widest THEN 'widest' END], lambda x: x IS NOT NULL), ',') AS differences, coalesce(a.seconds > 1.5 * b.seconds, false) AS slow, b.seconds IS NOT NULL AS known FROM r a LEFT JOIN r b ON a.class = b.class AND b.old WHERE NOT a.old")
def baseline_difference(t):
    def run(rows):
        return rows.groupBy(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("class")).agg(F.count("*").alias("n"), F.max("l_quantity").alias("widest"), F.round(F.sum("l_tax"), 6).alias("seconds"))

    old = F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp")
    out = J.baseline_difference(run(t.lineitem.filter(old)), run(t.lineitem.filter(~old)), "class", ["n", "widest"], "seconds")
    return out.select("class", F.array_join("differences", ",").alias("differences"), "slow", "known")


@query("j18_decision_canvas", "WITH u AS (SELECT DISTINCT l_orderkey AS unit, first_value(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS x1, first_value(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS w FROM lineitem) SELECT o_custkey AS document, count(*) AS boxes, count(*) FILTER (o_orderstatus = 'F') AS text_boxes, count(*) FILTER (o_orderstatus = 'P') AS empty_boxes FROM orders JOIN u ON o_orderkey = unit WHERE w > 5 GROUP BY 1")
def decision_canvas(t):
    u = J.first_of(t.lineitem.select(F.col("l_orderkey").alias("unit"), "l_partkey", "l_linenumber", "l_suppkey", F.col("l_quantity").alias("w")), ["unit"], "l_linenumber", "l_partkey", "l_suppkey")
    rows = t.orders.join(u, F.col("o_orderkey") == F.col("unit"), "left").filter(F.col("w") > 5)
    return rows.groupBy(F.col("o_custkey").alias("document")).agg(F.count("*").alias("boxes"), F.count_if(F.col("o_orderstatus") == "F").alias("text_boxes"), F.count_if(F.col("o_orderstatus") == "P").alias("empty_boxes"))


@query("j19_stage_overview", "WITH e AS (SELECT c_custkey AS k, 'source' AS s FROM customer UNION SELECT o_custkey, 'ordered' FROM orders UNION SELECT user_id, 'seen' FROM events) SELECT k, bool_or(s = 'source') AS has_source, bool_or(s = 'ordered') AS has_ordered, bool_or(s = 'seen') AS has_seen, (bool_or(s = 'ordered')::INT + bool_or(s = 'seen')::INT) AS stages FROM e GROUP BY k")
def stage_overview(t):
    k = lambda df, c: df.select(F.col(c).alias("k"))
    return J.flags(k(t.customer, "c_custkey"), {"ordered": k(t.orders, "o_custkey"), "seen": k(t.events, "user_id")}, "k")


@query("j20_dangling_references", "SELECT 'missing' AS kind, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey * 2) UNION ALL SELECT 'present', count(*) FROM lineitem WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey * 2)")
def dangling_references(t):
    refs, known = t.lineitem.select((F.col("l_suppkey") * 2).alias("s_suppkey")), t.supplier.select("s_suppkey")
    n = lambda kind, how: refs.join(known, "s_suppkey", how).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return n("missing", "left_anti").union(n("present", "left_semi"))


@query("j16_json_difference")
def json_difference(t):
    """Each event's properties against those of the user's next event."""
    from pyspark.sql import Window

    nxt = F.lead("props").over(Window.partitionBy("user_id").orderBy("event_id"))
    pairs = t.events.select(F.col("event_id").alias("id"), F.col("props").alias("before"), nxt.alias("after")).filter("after is not null")
    return J.json_difference(pairs).select("id", "path", "status", "old", "new", "total")


@query("s9_result_upsert", "SELECT o_custkey AS document, coalesce(b.phase, a.phase) AS phase, coalesce(b.n, a.n) AS n FROM (SELECT o_custkey, 'old' AS phase, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey, 'new' AS phase, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b USING (o_custkey)")
def result_upsert(t):
    """New phase results replace those of the same document; the others stay."""
    part = lambda s, n, p: t.orders.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("document")).agg(F.lit(n).alias(f"{p}_phase"), F.count("*").alias(f"{p}_n"))
    both = part("F", "old", "a").join(part("P", "new", "b"), "document", "full_outer")
    return both.select("document", F.coalesce("b_phase", "a_phase").alias("phase"), F.coalesce("b_n", "a_n").alias("n"))


@query("s14_artifact_catalog", "WITH a AS (SELECT event_id, event_type AS stage, 'f' || user_id || '/' || event_id AS path, CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS priority FROM events), c AS (SELECT stage, count(*) AS stage_total FROM a WHERE path LIKE '%1%' GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY priority, stage, path) AS k FROM a WHERE path LIKE '%1%') SELECT stage, path, k AS place, stage_total, (SELECT sum(stage_total) FROM c) > 500 AS truncated FROM r JOIN c USING (stage) WHERE k <= 500")
def artifact_catalog(t):
    """A filtered listing of at most 500 artifacts by priority; totals count all of them."""
    from pyspark.sql import Window

    e = F.col("event_type")
    a = t.events.select(e.alias("stage"), F.concat(F.lit("f"), "user_id", F.lit("/"), "event_id").alias("path"), F.when(e == "purchase", 0).when(e == "error", 1).otherwise(2).alias("priority")).filter(F.col("path").contains("1"))
    totals = a.groupBy("stage").agg(F.count("*").alias("stage_total"))
    first = a.orderBy("priority", "stage", "path").limit(500)
    every = totals.agg(F.sum("stage_total").alias("n")).select("n").scalar()
    out = first.withColumn("place", F.row_number().over(Window.orderBy("priority", "stage", "path")).cast("bigint")).join(F.broadcast(totals), "stage")
    return out.select("stage", "path", "place", "stage_total", (every > 500).alias("truncated"))
