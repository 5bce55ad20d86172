"""Profiles of line items by return flag, and what is scored against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.columns import percent
from vellum.operators import profiles as P

from .registry import query

_LONG = """l AS (SELECT l_returnflag AS class, l_orderkey * 8 + l_linenumber AS sample, l_orderkey * 8 + l_linenumber AS seq, unnest(['line', 'status', 'discount']) AS feature,
 unnest([l_linenumber::VARCHAR, l_linestatus, printf('%.2f', l_discount)]) AS value FROM lineitem)"""
_PROFILE = f"""{_LONG},
c AS (SELECT class, feature, value, count(*) AS n, min(seq) AS first FROM l GROUP BY ALL),
p AS (SELECT *, (sum(n) OVER w)::BIGINT AS total, row_number() OVER (w ORDER BY n DESC, first) AS rank, round_even(n * 100.0 / sum(n) OVER w, 0)::INT AS percent FROM c WINDOW w AS (PARTITION BY class, feature))"""


def long(t) -> DataFrame:
    """A row per line item and feature."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    pair = lambda n, v: F.struct(F.lit(n).alias("feature"), v.alias("value"))
    rows = t.lineitem.select(F.col("l_returnflag").alias("class"), key.alias("sample"), key.alias("seq"), F.explode(F.array(pair("line", F.col("l_linenumber").cast("string")), pair("status", F.col("l_linestatus")), pair("discount", F.format_string("%.2f", F.col("l_discount"))))).alias("f"))
    return rows.select("class", "sample", "seq", "f.feature", "f.value")


@query("a2_feature_distributions", f"WITH {_PROFILE} SELECT class, feature, value, n, total, percent, rank FROM p")
def feature_distributions(t):
    return P.distributions(long(t)).select("class", "feature", "value", "n", "total", "percent", F.col("rank").cast("bigint").alias("rank"))


@query("a3_modal_features", f"WITH {_PROFILE} SELECT class, feature, value, n, percent FROM p WHERE rank = 1")
def modal_features(t):
    return P.modes(P.distributions(long(t)))


@query("a7_common_and_secondary", f"WITH {_PROFILE} SELECT class, feature, value, percent, CASE WHEN percent >= 50 THEN 'common' ELSE 'secondary' END AS kind FROM p WHERE percent >= 10")
def common_and_secondary(t):
    profile = P.distributions(long(t))
    cols = ["class", "feature", "value", "percent"]
    return P.common(profile).select(*cols, F.lit("common").alias("kind")).unionByName(P.secondary(profile).select(*cols, F.lit("secondary").alias("kind")))


@query("a4_joint_signatures", f"""WITH {_LONG}, s AS (SELECT class, sample, min(seq) AS seq, string_agg(feature || '=' || value, ',' ORDER BY feature, value) AS signature FROM l WHERE feature <> 'line' GROUP BY class, sample),
c AS (SELECT class, signature, count(*) AS n, min(seq) AS first, arg_min(sample, seq) AS example FROM s GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY class) AS total, row_number() OVER (PARTITION BY class ORDER BY n DESC, first) AS rank FROM c)
SELECT class, signature, n, example, rank, round_even(n * 100.0 / total, 0)::INT AS percent FROM r WHERE rank <= 3""")
def joint_signatures(t):
    return P.signatures(long(t).filter("feature <> 'line'")).select("class", "signature", "n", "example", F.col("rank").cast("bigint").alias("rank"), "percent")


@query("a5_numeric_profiles", """WITH l AS (SELECT l_returnflag AS class, unnest(['price', 'quantity', 'tax']) AS feature, unnest([l_extendedprice, l_quantity, l_tax]) AS x FROM lineitem)
SELECT class, feature, count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(min(x), 6) AS low, round(max(x), 6) AS high, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.9), 6) AS p90, round(stddev_pop(x), 6) AS deviation FROM l GROUP BY ALL""")
def numeric_profiles(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("class"), "l_extendedprice", "l_quantity", "l_tax").unpivot(["class"], ["l_extendedprice", "l_quantity", "l_tax"], "name", "number")
    named = F.when(F.col("name") == "l_tax", "tax").when(F.col("name") == "l_quantity", "quantity").otherwise("price")
    return P.numbers(rows.withColumn("feature", named))


_PAIRS = """q AS (SELECT o_orderpriority AS class, o_orderdate < TIMESTAMP '{day}' AS early, unnest(['status', 'size']) AS feature, unnest([o_orderstatus, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END]) AS expected, unnest([l_linestatus, CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END]) AS observed FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
_DAY = "1998-01-01"


def expected_observed(t) -> DataFrame:
    """Order attributes against those of its line items, by priority."""
    j = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    size = lambda c: F.when(c, "large").otherwise("small")
    trio = lambda n, e, o: F.struct(F.lit(n).alias("feature"), e.alias("expected"), o.alias("observed"))
    rows = j.select(F.col("o_orderpriority").alias("class"), (F.col("o_orderdate") < F.lit(_DAY).cast("timestamp")).alias("early"), F.explode(F.array(trio("status", F.col("o_orderstatus"), F.col("l_linestatus")), trio("size", size(F.col("o_totalprice") > 200000), size(F.col("l_quantity") > 25)))).alias("f"))
    return rows.select("class", "early", "f.feature", "f.expected", "f.observed")


def _samples(rows: DataFrame) -> DataFrame:
    return rows.filter("feature = 'status'").groupBy("class").agg(F.count("*").alias("samples"))


@query("a6_expected_observed_errors", f"""WITH {_PAIRS.format(day=_DAY)}, s AS (SELECT class, count(*) AS samples FROM q WHERE feature = 'status' GROUP BY class)
SELECT class, feature, expected, observed, count(*) AS n, round_even(count(*) * 100.0 / any_value(samples), 0)::INT AS percent FROM q JOIN s USING (class) WHERE expected <> observed GROUP BY class, feature, expected, observed""")
def expected_observed_errors(t):
    rows = expected_observed(t)
    return P.errors(rows, _samples(rows)).select("class", "feature", "expected", "observed", "n", "percent")


@query("j14_watchlist", f"""WITH {_PAIRS.format(day=_DAY)}, s AS (SELECT early, class, count(*) AS samples FROM q WHERE feature = 'status' GROUP BY ALL),
e AS (SELECT early, class, feature, expected, observed, count(*) AS n, round_even(count(*) * 100.0 / any_value(samples), 0)::INT AS percent FROM q JOIN s USING (early, class) WHERE expected <> observed GROUP BY early, class, feature, expected, observed)
SELECT a.class, a.feature, a.expected, a.observed, a.n, a.percent, coalesce(b.percent, 0) AS previous, a.percent - coalesce(b.percent, 0) AS delta, CASE WHEN a.percent >= 10 THEN 'reached_watch_threshold' ELSE 'rising_minor_error' END AS reason
FROM e a LEFT JOIN e b ON b.early AND a.class = b.class AND a.feature = b.feature AND a.expected = b.expected AND a.observed = b.observed WHERE NOT a.early AND (a.percent >= 10 OR a.percent - coalesce(b.percent, 0) >= 5)""")
def watchlist(t):
    rows = expected_observed(t)
    made = [P.errors(part, _samples(part)) for part in (rows.filter("not early"), rows.filter("early"))]
    return P.watchlist(*made).select("class", "feature", "expected", "observed", "n", "percent", "previous", "delta", "reason")


_BAYES = f"""{_PROFILE},
o AS (SELECT o_orderkey AS obs, unnest(['line', 'status', 'discount']) AS feature, unnest([((o_orderkey % 9) + 1)::VARCHAR, o_orderstatus, printf('%.2f', (o_custkey % 13) / 100.0)]) AS value FROM orders),
i AS (SELECT unnest(['line', 'status']) AS feature, unnest(['high', 'medium']) AS importance),
f AS (SELECT class, feature, max(total) AS total, count(*) AS size, max(percent) FILTER (rank = 1) / 100.0 AS support FROM p GROUP BY class, feature),
x AS (SELECT f.*, (CASE importance WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.55 WHEN 'low' THEN 0.2 ELSE 0.1 END) * greatest(0.15, support) AS weight FROM f LEFT JOIN i USING (feature)),
y AS (SELECT obs, x.class, weight, weight * ln(greatest((coalesce(n, 0) + 0.5) / (x.total + 0.5 * greatest(2, size + CASE WHEN n IS NULL THEN 1 ELSE 0 END)), 1e-12)) AS term FROM o JOIN x USING (feature) LEFT JOIN p ON p.class = x.class AND p.feature = x.feature AND p.value = o.value),
z AS (SELECT obs, class, sum(term) AS log_score, sum(weight) AS weight, count(*) AS coverage FROM y GROUP BY obs, class),
e AS (SELECT *, exp((log_score - max(log_score) OVER (PARTITION BY obs)) / 3.0) AS e FROM z),
k AS (SELECT *, e / sum(e) OVER (PARTITION BY obs) AS likelihood, e / sum(e) OVER (PARTITION BY obs) * count(*) OVER (PARTITION BY obs) AS relative FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY obs ORDER BY round(likelihood, 12) DESC, class) AS rank, count(*) OVER (PARTITION BY obs) AS classes FROM k)"""


def scored(t) -> DataFrame:
    pair = lambda n, v: F.struct(F.lit(n).alias("feature"), v.alias("value"))
    observed = t.orders.select(F.col("o_orderkey").alias("obs"), F.explode(F.array(pair("line", (F.col("o_orderkey") % 9 + 1).cast("string")), pair("status", F.col("o_orderstatus")), pair("discount", F.format_string("%.2f", (F.col("o_custkey") % 13) / 100.0)))).alias("f")).select("obs", "f.*")
    importance = t.spark.createDataFrame([("line", "high"), ("status", "medium")], "feature string, importance string")
    return P.likelihoods(observed, P.distributions(long(t)), importance)


@query("r7_bayes_likelihoods", f"WITH {_BAYES} SELECT obs, class, coverage, rank, round(log_score, 6) AS log_score, round(exp(log_score / weight), 6) AS compatibility, round(likelihood, 6) AS likelihood, round(relative, 5) AS relative FROM r")
def bayes_likelihoods(t):
    return scored(t).select("obs", "class", "coverage", F.col("rank").cast("bigint").alias("rank"), *[F.round(c, 5 if c == "relative" else 6).alias(c) for c in ("log_score", "compatibility", "likelihood", "relative")])


@query("r8_soft_effects", f"""WITH {_BAYES} SELECT obs, class, 'boost' AS effect, round(greatest(0.01, least(1.0, (relative - 1.001) / 3.0)), 5) AS strength FROM r WHERE rank <= 5 AND relative >= 1.001
UNION ALL SELECT obs, class, 'weaken', round(greatest(0.01, least(1.0, (0.999 - relative) / 0.999)), 5) FROM r WHERE classes - rank < 5 AND relative <= 0.999""")
def soft_effects(t):
    return P.effects(scored(t), boost=1.001, weaken=0.999).withColumn("strength", F.round("strength", 5))


@query("r6_smoothed_probabilities", f"""WITH {_PROFILE}, s AS (SELECT class, feature, max(total) AS total, count(*) AS size FROM p GROUP BY ALL), v AS (SELECT DISTINCT feature, value FROM p UNION SELECT 'status', 'never')
SELECT s.class, s.feature, v.value, round((coalesce(n, 0) + 0.5) / (s.total + 0.5 * greatest(2, size + CASE WHEN n IS NULL THEN 1 ELSE 0 END)), 9) AS probability FROM s JOIN v USING (feature) LEFT JOIN p ON p.class = s.class AND p.feature = s.feature AND p.value = v.value""")
def smoothed_probabilities(t):
    p = P.distributions(long(t))
    sizes = p.groupBy("class", "feature").agg(F.max("total").alias("total"), F.count("*").alias("size"))
    values = p.select("feature", "value").union(t.spark.createDataFrame([("status", "never")], "feature string, value string")).distinct()
    rows = sizes.join(values, "feature").join(p.select("class", "feature", "value", "n"), ["class", "feature", "value"], "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("class", "feature", "value", F.round((n + 0.5) / (F.col("total") + 0.5 * F.greatest(F.lit(2), F.col("size") + F.when(n == 0, 1).otherwise(0))), 9).alias("probability"))


@query("a8_class_profiles", f"""WITH {_PROFILE}, m AS (SELECT class, string_agg(feature || '=' || value || ':' || percent, ',' ORDER BY feature) AS modes FROM p WHERE rank = 1 GROUP BY class)
SELECT class, modes, samples, features, row_number() OVER (ORDER BY class) AS place FROM m JOIN (SELECT class, count(DISTINCT sample) AS samples, count(DISTINCT feature) AS features FROM l GROUP BY class) USING (class)""")
def class_profiles(t):
    rows = long(t)
    modes = P.modes(P.distributions(rows)).groupBy("class").agg(F.array_join(F.array_sort(F.collect_list(F.concat("feature", F.lit("="), "value", F.lit(":"), F.col("percent").cast("string")))), ",").alias("modes"))
    sizes = rows.groupBy("class").agg(F.countDistinct("sample").alias("samples"), F.countDistinct("feature").alias("features"))
    # so few classes that one window over them is a handful of rows
    return modes.join(sizes, "class").selectExpr("class", "modes", "samples", "features", "cast(row_number() over (order by class) as bigint) as place")


@query("p24_distribution_lookup", f"WITH {_PROFILE} SELECT class, try_cast(value AS DOUBLE) AS number, n, percent FROM p WHERE feature = 'discount' AND try_cast(value AS DOUBLE) IS NOT NULL")
def distribution_lookup(t):
    p = P.distributions(long(t)).filter("feature = 'discount'").withColumn("number", F.col("value").try_cast("double"))
    return p.filter("number is not null").select("class", "number", "n", "percent")


@query("a12_feature_health", """WITH u AS (SELECT l_orderkey * 8 + l_linenumber AS seq, unnest(['price', 'discount', 'none', 'ratio']) AS feature, unnest([l_extendedprice, l_discount, 0.0, CASE WHEN l_tax = 0 THEN 'nan'::DOUBLE ELSE l_discount / l_tax END]) AS x FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY seq, x) AS k FROM u WHERE NOT isnan(x))
SELECT feature, any_value(bad) AS bad, count(*) AS finite, round(min(x), 6) AS low, round(max(x), 6) AS high, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation, round(avg((x = 0)::INT), 6) AS zero_ratio, count(DISTINCT x) FILTER (k <= 5000) AS distinct_values, min(x) = max(x) AS constant FROM f JOIN (SELECT feature, count(*) FILTER (isnan(x)) AS bad FROM u GROUP BY feature) USING (feature) GROUP BY feature""")
def feature_health(t):
    from pyspark.sql import Window

    x = F.col("x")
    wide = t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.lit(0.0).alias("none"), F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.try_divide("l_discount", "l_tax")).alias("ratio"))
    rows = wide.unpivot(["seq"], ["price", "discount", "none", "ratio"], "feature", "x")
    bad = rows.groupBy("feature").agg(F.count_if(F.isnan(x)).alias("bad"))
    finite = rows.filter(~F.isnan(x)).withColumn("k", F.row_number().over(Window.partitionBy("feature").orderBy("seq", "x")))
    out = finite.groupBy("feature").agg(F.count("*").alias("finite"), F.round(F.min(x), 6).alias("low"), F.round(F.max(x), 6).alias("high"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("deviation"), F.round(F.avg((x == 0).cast("int")), 6).alias("zero_ratio"), F.countDistinct(F.when(F.col("k") <= 5000, x)).alias("distinct_values"), (F.min(x) == F.max(x)).alias("constant"))
    return out.join(bad, "feature")


@query("p25_percents", "SELECT o_custkey, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS filled, round_even(count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*), 0)::INT AS percent FROM orders GROUP BY o_custkey")
def percents(t):
    out = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"))
    return out.withColumn("percent", percent(F.col("filled"), F.col("orders")))


@query("b16_error_identities", f"""WITH {_PAIRS.format(day=_DAY)} SELECT class, feature || '|' || expected || '|' || observed AS identity, sum(n)::BIGINT AS n FROM (SELECT class, feature, expected, observed, count(*) AS n FROM q WHERE expected <> observed AND early GROUP BY ALL UNION ALL SELECT class, feature, expected, observed, count(*) FROM q WHERE expected <> observed AND NOT early GROUP BY ALL) GROUP BY ALL""")
def error_identities(t):
    rows = expected_observed(t)
    made = [P.errors(part, _samples(part)) for part in (rows.filter("early"), rows.filter("not early"))]
    return made[0].unionByName(made[1]).groupBy("class", F.concat_ws("|", "feature", "expected", "observed").alias("identity")).agg(F.sum("n").alias("n"))
