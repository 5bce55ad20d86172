"""Words, n-grams, keys and repairs over the text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import columns as C
from vellum.operators import language_model as L
from vellum.operators.ordering import numbered
from vellum.sources.durable import store

from .registry import query

_LETTERS = r"\p{L}{2,}"
_WORDS = rf"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{_LETTERS}')) AS word FROM documents) GROUP BY word"
_MODEL = f"""w AS MATERIALIZED ({_WORDS}),
o AS (SELECT unnest([2, 3, 4]) AS o),
p AS (SELECT word, n, o, repeat('^', (o - 1)::INT) || word || '$' AS s FROM w, o),
g AS MATERIALIZED (SELECT word, n, o, unnest(list_transform(range(1, length(s) - o + 2), lambda i: substr(s, i, o))) AS g FROM p),
m AS MATERIALIZED (SELECT o, g, sum(ln(1 + n)) AS weight FROM g GROUP BY o, g),
t AS MATERIALIZED (SELECT o, sum(weight) AS total, count(*) AS size FROM m GROUP BY o),
lp AS MATERIALIZED (SELECT m.o, g, ln(greatest((weight + 0.1) / (total + 0.1 * size), 1e-12)) AS p FROM m JOIN t USING (o)),
s AS MATERIALIZED (SELECT word, avg(p) AS average FROM g JOIN lp USING (o, g) GROUP BY word),
r AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS rank FROM w),
z AS MATERIALIZED (SELECT avg(average) AS mean, greatest(stddev_pop(average), 1e-6) AS deviation FROM s JOIN r USING (word) WHERE rank <= 50000)"""


def words_of(text) -> Column:
    """Runs of two letters or more, of any alphabet, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_LETTERS})"), F.lit(1))


def vocabulary(t) -> DataFrame:
    """Words of all documents with their counts."""
    return t.documents.select(F.explode(words_of("text")).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def trained(t):
    """The n-gram model of the documents, its totals, the words' scores, and their spread."""
    words = store(vocabulary(t), "words")
    model = store(L.fit(words), "ngrams")
    of = L.totals(model)
    scored = store(L.averages(words, model, of), "scored")
    return model, of, scored, *L.spread(scored)


@query("a24_ngram_weights", f"WITH {_MODEL} SELECT o AS \"order\", g AS ngram, round(weight, 6) AS weight FROM m")
def ngram_weights(t):
    return L.fit(vocabulary(t)).select(F.col("order").cast("bigint"), "ngram", F.round("weight", 6).alias("weight"))


@query("f4_word_plausibility", f"WITH {_MODEL} SELECT word, n, round(average, 6) AS average, round((average - mean) / deviation, 5) AS z, round(1 / (1 + exp(-greatest(-12.0, least(12.0, (average - mean) / deviation)))), 5) AS confidence, (average - mean) / deviation < -2 AS gibberish FROM s JOIN w USING (word), z")
def word_plausibility(t):
    _, _, scored, mean, deviation = trained(t)
    out = L.judged(scored, mean, deviation)
    return out.select("word", F.col("count").alias("n"), F.round("average", 6).alias("average"), F.round("z", 5).alias("z"), F.round("confidence", 5).alias("confidence"), "gibberish")


_TOKENS = r"SELECT conv_id, turn, regexp_extract_all(text, '\S+') AS w FROM conversations"
_PUNCT = C.PUNCTUATION_TO_STRIP.replace("'", "''")


@query("f1_normalized_words", rf"""WITH a AS (SELECT unnest(w) AS raw FROM ({_TOKENS})), b AS (SELECT raw, lower(translate(trim(nfc_normalize(raw), '{_PUNCT}'), '-֊', '')) AS word FROM a)
SELECT word, count(*) AS n, count(DISTINCT raw) AS forms, length(word)::BIGINT AS letters, length(translate(word, 'abcdefghijklmnopqrstuvwxyz', ''))::BIGINT AS unknown,
round(length(translate(word, 'abcdefghijklmnopqrstuvwxyz', '')) / greatest(1, length(word)), 6) AS unknown_ratio,
array_to_string(list_sort(list_distinct(list_filter(string_split(word, ''), lambda c: c <> '' AND strpos('abcdefghijklmnopqrstuvwxyz', c) = 0))), '') AS unknown_letters FROM b GROUP BY word""")
def normalized_words(t):
    raw = t.conversations.select(F.explode(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1))).alias("raw"))
    az = "abcdefghijklmnopqrstuvwxyz"
    out = raw.withColumn("word", C.normalized(F.col("raw"))).groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("raw").alias("forms"))
    return out.select("word", "n", "forms", F.length("word").cast("bigint").alias("letters"), C.unknown_count(F.col("word"), az).cast("bigint").alias("unknown"), F.round(C.per(C.unknown_count(F.col("word"), az), F.length("word")), 6).alias("unknown_ratio"), F.concat_ws("", C.unknown_letters(F.col("word"), az)).alias("unknown_letters"))


@query("f5_suffix_hints", r"SELECT word, n, suffix, (length(word) - length(suffix))::BIGINT AS start, length(word)::BIGINT AS stop, 0.35::DOUBLE AS confidence FROM (" + _WORDS + r"), (SELECT unnest(['ing', 'tion', 'ment', 'heit']) AS suffix) WHERE ends_with(word, suffix) AND length(word) > length(suffix)")
def suffix_hints(t):
    out = vocabulary(t).select("word", F.col("count").alias("n"), F.explode(C.suffix_hints(F.col("word"), ("ing", "tion", "ment", "heit"))).alias("h"))
    return out.select("word", "n", "h.suffix", F.col("h.start").cast("bigint").alias("start"), F.col("h.stop").cast("bigint").alias("stop"), "h.confidence")


@query("f6_lexicon_membership", rf"SELECT item_id, count(*) AS words, count(*) FILTER (word IN (SELECT word FROM ({_WORDS}))) AS known FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{_LETTERS}')) AS word FROM benchmark) GROUP BY item_id")
def lexicon_membership(t):
    asked = t.benchmark.select("item_id", F.explode(words_of("text")).alias("word"))
    known = vocabulary(t).select("word", F.lit(1).alias("known"))
    return asked.join(known, "word", "left").groupBy("item_id").agg(F.count("*").alias("words"), F.count("known").alias("known"))


@query("f10_language_prior", f"WITH w AS ({_WORDS}) SELECT word, n, round(least(1.0, ln(1 + n) / ln(1 + (SELECT sum(n) FROM w))), 9) AS prior, round(n / greatest(1, (SELECT max(n) FROM w)), 9) AS confidence FROM w")
def language_prior(t):
    words = vocabulary(t)
    both = words.agg(F.struct(F.sum("count").alias("total"), F.max("count").alias("top")).alias("s")).scalar()
    total, top = both["total"], both["top"]
    return words.select("word", F.col("count").alias("n"), F.round(F.least(F.lit(1.0), F.log1p(F.col("count").cast("double")) / F.log1p(total.cast("double"))), 9).alias("prior"), F.round(C.per(F.col("count"), top), 9).alias("confidence"))


@query("o7_top_language_candidates", f"WITH w AS ({_WORDS}) SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank, round(n / (max(n) OVER ()), 9) AS confidence FROM (SELECT * FROM w ORDER BY n DESC, word LIMIT 200)")
def top_language_candidates(t):
    top = vocabulary(t).orderBy(F.desc("count"), "word").limit(200)
    return top.select("word", F.col("count").alias("n"), F.row_number().over(Window.orderBy(F.desc("count"), "word")).cast("bigint").alias("rank"), F.round(F.col("count") / F.max("count").over(Window.partitionBy()), 9).alias("confidence"))


@query("f20_document_lines", r"""SELECT doc_id, line - 1 AS line, trim(t, chr(32) || chr(9) || chr(13)) AS said FROM (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE trim(t, chr(32) || chr(9) || chr(13)) <> ''""")
def document_lines(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.select("doc_id", F.col("line").cast("bigint").alias("line"), F.btrim("t", F.lit(" \t\r")).alias("said")).filter("said <> ''")


@query("f18_identities", r"SELECT part, digest, ('0x' || substr(digest, 1, 16))::UHUGEINT::VARCHAR AS seed, variant FROM (SELECT p_partkey AS part, v AS variant, sha256(concat_ws('|', p_partkey, p_name, v)) AS digest FROM part, (SELECT unnest(range(0, 3)) AS v))")
def identities(t):
    rows = t.part.select(F.col("p_partkey").alias("part"), "p_name", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("variant"))
    return rows.withColumn("digest", C.identity(F.col("part"), F.col("p_name"), F.col("variant"))).select("part", "digest", C.seed(F.col("digest")).cast("string").alias("seed"), "variant")


@query("f19_slugs", r"SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^0-9A-Za-z_-]+', '_', 'g'), '_'), ''), 'unknown') AS slug FROM pages")
def slugs(t):
    return t.pages.select("page_id", C.slug(F.col("url")).alias("slug"))


@query("f21_canonical_values", r"SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = floor(l_discount) THEN printf('%d', l_discount::BIGINT) ELSE printf('%.4f', l_discount) END AS discount, CASE WHEN l_quantity = floor(l_quantity) THEN printf('%d', l_quantity::BIGINT) ELSE printf('%.4f', l_quantity) END AS quantity, CASE WHEN l_tax > 0.04 THEN 'true' ELSE 'false' END AS taxed, l_returnflag AS flag FROM lineitem")
def canonical_values(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", C.canonical(F.col("l_discount")).alias("discount"), C.canonical(F.col("l_quantity")).alias("quantity"), C.canonical(F.col("l_tax") > 0.04).alias("taxed"), C.canonical(F.col("l_returnflag")).alias("flag"))


@query("o1_natural_order", r"SELECT c_custkey, c_name, row_number() OVER (ORDER BY n, c_custkey) AS place FROM (SELECT c_custkey, 'Page ' || (c_custkey % 97) || '-' || c_mktsegment AS c_name, list_transform(regexp_extract_all(lower('Page ' || (c_custkey % 97) || '-' || c_mktsegment), '\d+|\D+'), lambda p: CASE WHEN regexp_matches(p, '^\d') THEN '0' || lpad(p, 20, '0') ELSE '1' || p END) AS n FROM customer)")
def natural_order(t):
    named = t.customer.select("c_custkey", F.concat(F.lit("Page "), F.col("c_custkey") % 97, F.lit("-"), "c_mktsegment").alias("c_name"))
    keyed = named.withColumn("key", C.natural_key(F.col("c_name")))
    return numbered(keyed, "key", "c_custkey").select("c_custkey", "c_name", "place")


@query("f9_edit_distance", r"WITH b AS (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS s FROM benchmark), n AS (SELECT item_id, s, lead(s) OVER (ORDER BY item_id) AS o FROM b) SELECT item_id, levenshtein(s, o)::BIGINT AS edits, round(levenshtein(s, o) / greatest(1, length(s)), 6) AS rate, s = o AS exact FROM n WHERE o IS NOT NULL")
def edit_distance(t):
    b = t.benchmark.select("item_id", F.regexp_replace("text", "[^ -~]", "").alias("s"))
    placed = numbered(b, "item_id")
    after = placed.select((F.col("place") - 1).alias("place"), F.col("s").alias("o"))
    n = placed.join(after, "place").filter("o is not null")
    return n.select("item_id", F.levenshtein("s", "o").cast("bigint").alias("edits"), F.round(C.per(F.levenshtein("s", "o"), F.length("s")), 6).alias("rate"), (F.col("s") == F.col("o")).alias("exact"))


@query("a13_error_rates", r"WITH b AS (SELECT item_id, lower(regexp_replace(text, '[^ -~]', '', 'g')) AS truth FROM benchmark), p AS (SELECT item_id, truth, replace(replace(truth, 'th', 't'), 'er', 're') AS said FROM b) SELECT count(*) AS texts, sum(levenshtein(truth, said))::BIGINT AS edits, sum(greatest(1, length(truth)))::BIGINT AS letters, round(sum(levenshtein(truth, said)) / sum(greatest(1, length(truth))), 9) AS character_error_rate, round(avg((truth = said)::INT), 9) AS word_accuracy, round(avg((length(truth) = length(said))::INT), 9) AS length_accuracy FROM p")
def error_rates(t):
    p = t.benchmark.select(F.lower(F.regexp_replace("text", "[^ -~]", "")).alias("truth")).withColumn("said", F.replace(F.replace("truth", F.lit("th"), F.lit("t")), F.lit("er"), F.lit("re")))
    edits, letters = F.sum(F.levenshtein("truth", "said")), F.sum(F.greatest(F.lit(1), F.length("truth")))
    return p.agg(F.count("*").alias("texts"), edits.cast("bigint").alias("edits"), letters.alias("letters"), F.round(edits / letters, 9).alias("character_error_rate"), F.round(F.avg((F.col("truth") == F.col("said")).cast("int")), 9).alias("word_accuracy"), F.round(F.avg((F.length("truth") == F.length("said")).cast("int")), 9).alias("length_accuracy"))


def repair_tokens(t) -> DataFrame:
    """Distinct words of the benchmark with invented backups at each of their positions."""
    text = t.benchmark.select(F.explode(words_of("text")).alias("text")).distinct()
    token = F.ascii("text") + 31 * F.length("text")
    at = text.select(token.alias("number"), "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("position"))
    held = ((F.col("number") * 7 + F.col("position") * 5) % 11) / 11.0
    alt = at.withColumn("held", held).select("*", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("k"))
    char = F.substring(F.lit("etaoinshrdlu"), ((F.col("number") + F.col("position") * 3 + F.col("k") * 5) % 12 + 1).cast("int"), F.lit(1))
    return alt.select(F.col("text").alias("token"), "text", "position", "held", char.alias("char"), (0.5 - 0.1 * F.col("k")).cast("double").alias("confidence"))


@query("r12_ngram_repairs", f"""WITH {_MODEL},
a AS MATERIALIZED (SELECT text AS token, text, unicode(text) + 31 * length(text) AS number FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_LETTERS}')) AS text FROM benchmark)),
b AS (SELECT token, text, position, ((number * 7 + position * 5) % 11) / 11.0 AS held, k, substr('etaoinshrdlu', ((number + position * 3 + k * 5) % 12 + 1)::INT, 1) AS c, 0.5 - 0.1 * k AS f FROM (SELECT *, unnest(range(0, length(text))) AS position FROM a), (SELECT unnest(range(0, 2)) AS k)),
d AS (SELECT *, dense_rank() OVER (PARTITION BY token ORDER BY held, position) AS place FROM b WHERE c <> substr(text, (position + 1)::INT, 1)),
e AS MATERIALIZED (SELECT * FROM d WHERE place <= 6),
tried AS MATERIALIZED (SELECT token, text, substr(text, 1, position::INT) || c || substr(text, (position + 2)::INT) AS repaired, 1 AS changes, greatest(0.001, f) AS product FROM e
 UNION ALL SELECT x.token, x.text, substr(x.text, 1, x.position::INT) || x.c || substr(x.text, (x.position + 2)::INT, (y.position - x.position - 1)::INT) || y.c || substr(x.text, (y.position + 2)::INT), 2, greatest(0.001, x.f) * greatest(0.001, y.f) FROM e x JOIN e y ON x.token = y.token AND x.position < y.position),
every AS MATERIALIZED (SELECT DISTINCT text AS word FROM a UNION SELECT DISTINCT repaired FROM tried),
eg AS (SELECT word, o, unnest(list_transform(range(1, length(word) + 2), lambda i: substr(repeat('^', (o - 1)::INT) || word || '$', i, o))) AS g FROM every, o),
u AS (SELECT o, ln(greatest(0.1 / (total + 0.1 * size), 1e-12)) AS unseen FROM t),
sc AS MATERIALIZED (SELECT word, avg(coalesce(p, unseen)) AS average FROM eg LEFT JOIN lp USING (o, g) JOIN u USING (o) GROUP BY word),
j AS (SELECT token, tried.text, repaired, changes, product, (n.average - mean) / deviation AS z, (n.average - own.average) / deviation AS gain FROM tried JOIN sc own ON own.word = tried.text JOIN sc n ON n.word = repaired, z)
SELECT token, max(round(z, 5)) AS best_z, max(round(gain, 5)) AS best_gain, least(12, count(*)) AS n FROM j WHERE gain >= 0.15 GROUP BY token""")
def ngram_repairs(t):
    model, of, _, mean, deviation = trained(t)
    tried = store(L.candidates(repair_tokens(t)), "tried")
    every = tried.select(F.col("text").alias("word")).union(tried.select("repaired")).distinct()
    best = L.repairs(tried, L.averages(every, model, of), mean, deviation)
    return best.groupBy("token").agg(F.max(F.round("z", 5)).alias("best_z"), F.max(F.round("gain", 5)).alias("best_gain"), F.count("*").alias("n"))
