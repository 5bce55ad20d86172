"""Evaluation queries over embeddings, labels and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions.columns import per
from vellum.operators import metrics as M

from .registry import query

_SAID = "p AS (SELECT vec_id, label::BIGINT AS truth, (list_position(embedding, list_max(embedding)) - 1) % 10 AS said FROM embeddings)"


def predictions(t):
    """A vector's label, and the place of its largest component modulo ten as prediction."""
    best = F.array_position(F.col("embedding"), F.array_max("embedding")) - 1
    return t.embeddings.select("vec_id", F.col("label").cast("bigint").alias("truth"), (best % 10).alias("said"))


_PAIRS = f"WITH {_SAID}, c AS (SELECT truth, said, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT *, (sum(n) OVER (PARTITION BY truth))::BIGINT AS support FROM c)"


@query("a9_confusion_pairs", f"{_PAIRS} SELECT truth, said, n, support, round(n / greatest(1, support), 6) AS share FROM s WHERE truth <> said")
def confusion_pairs(t):
    return M.confusion(predictions(t)).withColumn("share", F.round("share", 6))


@query("s13_confusion_matrix", f"WITH {_SAID}, k AS (SELECT DISTINCT truth AS k FROM p UNION SELECT said FROM p) SELECT a.k AS truth, b.k AS said, (SELECT count(*) FROM p WHERE p.truth = a.k AND p.said = b.k) AS n FROM k a, k b")
def confusion_matrix(t):
    """The dense matrix over all classes that are true or said."""
    p = predictions(t)
    classes = p.select(F.explode(F.array("truth", "said")).alias("k")).distinct().agg(F.array_sort(F.collect_list("k")).alias("all"))  # one row: the classes
    every = classes.select(F.explode("all").alias("truth"), "all").select("truth", F.explode("all").alias("said"))
    return every.join(M.confusion(p, keep_equal=True).select("truth", "said", "n"), ["truth", "said"], "left").select("truth", "said", F.coalesce("n", F.lit(0)).alias("n"))


@query("a10_per_class_stats", f"""WITH {_SAID}, k AS (SELECT truth AS class FROM p UNION SELECT said FROM p), s AS (SELECT class, (SELECT count(*) FROM p WHERE truth = class) AS support, (SELECT count(*) FROM p WHERE said = class) AS said, (SELECT count(*) FROM p WHERE truth = class AND p.said = class) AS hits FROM k),
r AS (SELECT *, hits / greatest(1, said) AS p, hits / greatest(1, support) AS r FROM s) SELECT class, support, said, hits, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM r""")
def per_class_stats(t):
    return M.per_class(predictions(t))


_TOP = "WITH e AS (SELECT vec_id, label, i - 1 AS c, embedding[i]::DOUBLE AS s FROM embeddings, unnest(range(1, len(embedding) + 1)) t(i)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) AS rank, exp(s - max(s) OVER (PARTITION BY vec_id)) AS x FROM e), q AS (SELECT *, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM r)"


@query("w3_top_k_predictions", f"{_TOP}, h AS (SELECT vec_id, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / ln(count(*)) AS entropy FROM q GROUP BY vec_id), m AS (SELECT vec_id, max(s) FILTER (rank = 1) - max(s) FILTER (rank = 2) AS margin FROM q GROUP BY vec_id) SELECT vec_id, rank, c AS class_id, round(s, 6) AS score, round(margin, 6) AS margin, round(entropy, 6) AS entropy FROM q JOIN h USING (vec_id) JOIN m USING (vec_id) WHERE rank <= 5")
def top_k_predictions(t):
    rows = t.embeddings.select("vec_id", M.top_k(F.col("embedding"), 5).alias("top"), M.entropy(M.softmax(F.col("embedding"))).alias("entropy"))
    rows = rows.withColumn("margin", F.col("top")[0]["score"] - F.col("top")[1]["score"])
    return rows.select("vec_id", F.posexplode("top").alias("k", "x"), "margin", "entropy").select("vec_id", (F.col("k") + 1).cast("bigint").alias("rank"), F.col("x.class_id").cast("bigint").alias("class_id"), F.round("x.score", 6).alias("score"), F.round("margin", 6).alias("margin"), F.round("entropy", 6).alias("entropy"))


@query("a11_accuracy_by_slice", f"{_TOP} SELECT vec_id % 4 AS slice, count(DISTINCT vec_id) AS n, round(sum((rank = 1 AND c = label)::INT) / count(DISTINCT vec_id), 6) AS top1, round(sum((rank <= 5 AND c = label)::INT) / count(DISTINCT vec_id), 6) AS top5 FROM q GROUP BY 1")
def accuracy_by_slice(t):
    top = F.transform(M.top_k(F.col("embedding"), 5), lambda x: x["class_id"])
    rows = t.embeddings.select((F.col("vec_id") % 4).alias("slice"), (top[0] == F.col("label")).cast("int").alias("one"), F.array_contains(top, F.col("label")).cast("int").alias("five"))
    return rows.groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg("one"), 6).alias("top1"), F.round(F.avg("five"), 6).alias("top5"))


_BINS = """b AS (SELECT l_orderkey AS unit, list_sort(list(DISTINCT l_partkey % 16) FILTER (l_discount < 0.06)) AS truth, list_sort(list(DISTINCT (l_partkey + CASE WHEN l_tax > 0.05 THEN 1 ELSE 0 END) % 16) FILTER (l_discount < 0.08)) AS said FROM lineitem GROUP BY 1), c AS (SELECT unit, coalesce(truth, []) AS truth, coalesce(said, []) AS said FROM b)"""


def bins(t):
    i = F.col
    return t.lineitem.groupBy(i("l_orderkey").alias("unit")).agg(F.array_sort(F.collect_set(F.when(i("l_discount") < 0.06, i("l_partkey") % 16))).alias("truth"), F.array_sort(F.collect_set(F.when(i("l_discount") < 0.08, (i("l_partkey") + F.when(i("l_tax") > 0.05, 1).otherwise(0)) % 16))).alias("said"))


@query("a14_boundary_metrics", f"""WITH {_BINS}, m AS (SELECT sum(len(list_intersect(truth, said)))::BIGINT AS tp, sum(len(said) - len(list_intersect(truth, said)))::BIGINT AS fp, sum(len(truth) - len(list_intersect(truth, said)))::BIGINT AS fn, avg((truth = said)::INT) AS exact, avg((abs(len(truth) - len(said)) <= 1)::INT) AS w FROM c)
SELECT tp, fp, fn, round(exact, 9) AS exact, round(w, 9) AS count_within_one, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1 FROM m""")
def boundary_metrics(t):
    return M.boundaries(bins(t)).select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("exact", "count_within_one", "precision", "recall", "f1")])


@query("a15_path_hits", f"""WITH {_BINS}, h AS (SELECT unit, list_transform([0, 1, 2, 3, 4], lambda k: list_sort(list_distinct(list_transform(said, lambda x: (x + k) % 16))) = truth) AS exact, list_transform([0, 1, 2, 3, 4], lambda k: abs(len(said) + k - len(truth)) <= 1) AS near FROM c)
SELECT count(*) AS units, round(avg(exact[1]::INT), 9) AS top1, round(avg((list_contains(exact[1:3], true))::INT), 9) AS top3, round(avg((list_contains(exact, true))::INT), 9) AS top5, round(avg((list_contains(near[1:3], true))::INT), 9) AS near3 FROM h""")
def path_hits(t):
    """Hit rates of the first 1, 3 and 5 of five candidate paths (bins moved by 0 to 4)."""
    shifts = F.array(*map(F.lit, range(5)))
    moved = F.transform(shifts, lambda k: F.array_sort(F.array_distinct(F.transform("said", lambda x: (x + k) % 16))) == F.col("truth"))
    near = F.transform(shifts, lambda k: F.abs(F.size("said") + k - F.size("truth")) <= 1)
    rows = bins(t).select(moved.alias("exact"), near.alias("near"))
    rate = lambda c, k: F.round(F.avg(F.exists(F.slice(c, 1, k), lambda x: x).cast("int")), 9)
    return rows.agg(F.count("*").alias("units"), rate("exact", 1).alias("top1"), rate("exact", 3).alias("top3"), rate("exact", 5).alias("top5"), rate("near", 3).alias("near3"))


@query("a16_utility_scores", "SELECT l_returnflag AS run, round(avg(l_discount) * 0.5 + avg(l_tax) * 0.3 + coalesce(avg(CASE WHEN l_quantity > 49 THEN l_quantity / 50 END), 0) * 0.2, 9) AS utility FROM lineitem GROUP BY 1")
def utility_scores(t):
    m = t.lineitem.groupBy(F.col("l_returnflag").alias("run")).agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"), F.avg(F.when(F.col("l_quantity") > 49, F.col("l_quantity") / 50)).alias("c"))
    return m.select("run", F.round(M.utility({k: F.col(k) for k in "abc"}, {"a": 0.5, "b": 0.3, "c": 0.2}), 9).alias("utility"))


_MEMORY = f"""{_PAIRS}, f AS (SELECT truth, said, n, n / greatest(1, support) AS share FROM s WHERE truth <> said),
l AS (SELECT quality AS truth, toxic AS said, count(*) AS n FROM labels GROUP BY ALL), g AS (SELECT truth, said, n, n / greatest(1, sum(n) OVER (PARTITION BY truth)) AS share FROM l),
u AS (SELECT said AS predicted, truth AS "true", n * 1.0 AS weighted, share, 'vectors' AS source FROM f UNION ALL SELECT said, truth, n * 0.5, share, 'labels' FROM g WHERE truth <> said),
m AS (SELECT predicted, "true", sum(weighted)::DOUBLE AS weighted, max(share) AS share, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM u GROUP BY ALL)"""


def remembered(t):
    labels = t.labels.select(F.col("quality").cast("bigint").alias("truth"), F.col("toxic").cast("bigint").alias("said"))
    return M.memory([("vectors", 1.0, M.confusion(predictions(t))), ("labels", 0.5, M.confusion(labels))])


@query("a18_confusion_memory", f"{_MEMORY} SELECT predicted, \"true\", weighted, round(share, 9) AS share, sources FROM m")
def confusion_memory(t):
    return remembered(t).withColumn("share", F.round("share", 9))


@query("j6_top_alternatives", f"{_MEMORY}, k AS (SELECT predicted, \"true\", round(least(1.0, weighted / 20.0 * 0.55 + share * 0.45), 9) AS risk FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY predicted ORDER BY risk DESC, \"true\"::VARCHAR) AS rank FROM k) SELECT predicted, \"true\", risk, rank FROM r WHERE rank <= 8")
def top_alternatives(t):
    from pyspark.sql import Window

    m = remembered(t).withColumn("risk", F.round(M.risk(F.col("weighted"), F.col("share")), 9))
    rank = F.row_number().over(Window.partitionBy("predicted").orderBy(F.desc("risk"), F.col("true").cast("string")))
    return m.select("predicted", "true", "risk", rank.cast("bigint").alias("rank")).filter("rank <= 8")


@query("r13_position_alerts", f"""{_MEMORY}, k AS (SELECT predicted, max(least(1.0, weighted / 20.0 * 0.55 + share * 0.45)) AS risk FROM m GROUP BY predicted)
SELECT vec_id, said, round(coalesce(risk, 0), 6) AS risk, round(0.8 * (1 - 0.5 * coalesce(risk, 0)), 6) AS adjusted, coalesce(risk, 0) >= 0.5 AS alert FROM p LEFT JOIN k ON said = predicted""")
def position_alerts(t):
    """Scores lowered by the largest risk of the predicted class, and an alert from 0.5 on."""
    k = remembered(t).groupBy(F.col("predicted").alias("said")).agg(F.max(M.risk(F.col("weighted"), F.col("share"))).alias("risk"))
    risk = F.coalesce("risk", F.lit(0.0))
    return predictions(t).join(k, "said", "left").select("vec_id", "said", F.round(risk, 6).alias("risk"), F.round(0.8 * (1 - 0.5 * risk), 6).alias("adjusted"), (risk >= 0.5).alias("alert"))


@query("a20_source_coverage", "SELECT o_custkey AS unit, round(avg(l_discount) FILTER (l_quantity > 5), 9) AS confidence, count(*) FILTER (l_returnflag = 'A') AS trace, count(*) FILTER (l_returnflag = 'N') AS glyph, count(*) FILTER (l_returnflag = 'R') AS word, count(*) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def source_coverage(t):
    j = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    n = lambda f: F.count_if(F.col("l_returnflag") == f)
    return j.groupBy(F.col("o_custkey").alias("unit")).agg(F.round(F.avg(F.when(F.col("l_quantity") > 5, F.col("l_discount"))), 9).alias("confidence"), n("A").alias("trace"), n("N").alias("glyph"), n("R").alias("word"), F.count("*").alias("total"))


@query("a28_ocr_summaries", "SELECT l_orderkey AS page, count(*) FILTER (l_quantity > 3 AND l_linenumber % 7 <> 6) AS words, round(avg(l_discount * 1000 - 1) FILTER (l_quantity > 3 AND l_linenumber % 7 <> 6 AND l_discount * 1000 >= 1), 3) AS mean, round(min(l_discount * 1000 - 1) FILTER (l_quantity > 3 AND l_linenumber % 7 <> 6 AND l_discount * 1000 >= 1), 3) AS low, round(max(l_discount * 1000 - 1) FILTER (l_quantity > 3 AND l_linenumber % 7 <> 6 AND l_discount * 1000 >= 1), 3) AS high FROM lineitem GROUP BY 1")
def ocr_summaries(t):
    """Words of a page, and statistics of confidences from 0 up; none gives nulls."""
    conf, word = F.col("l_discount") * 1000 - 1, (F.col("l_quantity") > 3) & (F.col("l_linenumber") % 7 != 6)
    c = F.when(word & (F.col("l_discount") * 1000 >= 1), conf)
    return t.lineitem.groupBy(F.col("l_orderkey").alias("page")).agg(F.count_if(word).alias("words"), F.round(F.avg(c), 3).alias("mean"), F.round(F.min(c), 3).alias("low"), F.round(F.max(c), 3).alias("high"))


@query("a27_line_counts", "SELECT lang, source, count(*) AS files, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY ALL")
def line_counts(t):
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("files"), F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("bigint").alias("lines"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"))


@query("a22_token_overlays", "SELECT l_orderkey AS token, round(avg(l_discount), 9) AS score, count(*) FILTER (l_tax >= 0.07) AS alerts, CASE WHEN count(*) FILTER (l_tax >= 0.07) = 0 THEN 'keep_decision' WHEN count(*) FILTER (l_tax >= 0.07) * 2 >= count(*) THEN 'prefer_review' ELSE 'check_alternatives' END AS advice FROM lineitem GROUP BY 1")
def token_overlays(t):
    alerts = F.count_if(F.col("l_tax") >= 0.07)
    return t.lineitem.groupBy(F.col("l_orderkey").alias("token")).agg(F.round(F.avg("l_discount"), 9).alias("score"), alerts.alias("alerts"), F.when(alerts == 0, "keep_decision").when(alerts * 2 >= F.count("*"), "prefer_review").otherwise("check_alternatives").alias("advice"))


@query("a29_run_catalog", "SELECT o_custkey AS run, round(coalesce(max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 0), 2) AS metric, max(o_orderdate) AS newest, count(*) AS reports FROM orders GROUP BY 1")
def run_catalog(t):
    of = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    return t.orders.groupBy(F.col("o_custkey").alias("run")).agg(F.round(F.coalesce(of("F"), of("O"), F.lit(0.0)), 2).alias("metric"), F.max("o_orderdate").alias("newest"), F.count("*").alias("reports"))
