"""Model queries: score columns in, rankings out; a forest trained by Spark ML."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import metrics, models

from .registry import query


@query("m3_expert_contract", "WITH e AS (SELECT vec_id, i - 1 AS c, embedding[i]::DOUBLE AS s FROM embeddings, unnest(range(1, len(embedding) + 1)) t(i)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) AS rank FROM e) SELECT vec_id AS crop_id, true AS attempted, 'completed' AS status, string_agg('L' || c, ',' ORDER BY rank) AS labels FROM r WHERE rank <= 5 GROUP BY vec_id")
def expert_contract(t):
    """An expert whose scores are a vector's components: five candidates a crop."""
    expert = models.Expert("vectors", lambda crops: crops.withColumn("scores", F.transform("embedding", lambda x: x.cast("double"))), enabled=True)
    first = t.embeddings.select(F.size("embedding")).first()
    out = expert.run(t.embeddings.select(F.col("vec_id").alias("crop_id"), "embedding"), [f"L{k}" for k in range(first[0] if first else 1)])
    return out.select("crop_id", "attempted", "status", F.array_join(F.transform("candidates", lambda c: c["label"]), ",").alias("labels"))


@query("m3_disabled_expert", "SELECT vec_id AS crop_id, false AS attempted, 'disabled' AS status, 0::BIGINT AS candidates FROM embeddings")
def disabled_expert(t):
    expert = models.Expert("vectors", lambda crops: crops, enabled=False)
    return expert.run(t.embeddings.select(F.col("vec_id").alias("crop_id")), []).withColumn("candidates", F.size("candidates").cast("bigint"))


@query("m5_forest_accuracy")
def forest_accuracy(t):
    """Accuracy of a random forest on held-out vectors, top one and top five."""
    rows = t.embeddings.select("vec_id", F.col("label").alias("class"), F.col("embedding").alias("vector"))
    held = F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0
    model = models.forest(rows.filter(~held))
    p = models.predicted(model, rows.filter(held), "vec_id")
    top = F.transform(metrics.top_k(F.col("scores"), 5), lambda x: x["class_id"])
    return p.agg(F.count("*").alias("n"), F.round(F.avg((F.col("said") == F.col("class")).cast("int")), 6).alias("top1"), F.round(F.avg(F.array_contains(top, F.col("class")).cast("int")), 6).alias("top5"))


@query("m7_feature_projection", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_tax > 0.03 THEN l_tax END, 0) AS tax, coalesce(CASE WHEN l_discount > 0.05 THEN l_discount END, 0) AS discount, l_quantity AS quantity FROM lineitem")
def feature_projection(t):
    """A fixed order of features with 0 for those that a row lacks."""
    i = F.col
    some = F.map_filter(F.create_map(F.lit("tax"), i("l_tax"), F.lit("discount"), i("l_discount"), F.lit("quantity"), i("l_quantity")), lambda k, v: (k == "quantity") | ((k == "tax") & (v > 0.03)) | ((k == "discount") & (v > 0.05)))
    full = F.map_concat(F.map_filter(F.create_map(F.lit("tax"), F.lit(0.0), F.lit("discount"), F.lit(0.0)), lambda k, _: ~F.map_contains_key(some, k)), some)
    v = models.ordered(full, ["tax", "discount", "quantity"])
    return t.lineitem.select("l_orderkey", "l_linenumber", v[0].alias("tax"), v[1].alias("discount"), v[2].alias("quantity"))
