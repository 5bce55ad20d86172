"""Empty tables, nulls, repeated rows, very long texts and clashing names; the registered queries on a small folder."""

import collections
import hashlib
import random
import re

import pytest

import corpus_pipeline
from vellum.llm import decontamination, language_id, near_dedup, packing, pii, url_filter
from vellum.llm import queries as registered

from .test_text_operators import DOCS, bag, rows_of, say, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(21)
LONG = say(60_000, R)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("small")
    base = [say(R.randint(20, 90), R) for _ in range(30)]
    texts = [*base, base[0], base[0], base[1] + " more", None, "", " \n", LONG, "write to a.b@c.org or 10.0.0.1", "Licensed under the MIT License."]
    rows = [(k, t, ("en", "de")[k % 2], "s", len(t or "")) for k, t in enumerate(texts)] + [(None, base[2], "en", None, None), (3, "another text under an id that came before", "de", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, base[4]), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    pages = [(k, f"https://h{k % 5}.example.com/{'x' * (k * 400)}?q", f"<p>{k % 4}</p>") for k in range(20)] + [(100, None, None), (101, "no scheme", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{out}/pages.parquet")
    return str(out), rows, pages


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_every_query_judges_every_row_and_leaves_settings_alone(spark, folder, name):
    path, rows, pages = folder
    before = dict(spark.conf.getAll)
    got = registered.queries()[name](spark, path).collect()
    assert dict(spark.conf.getAll) == before
    if name in ("op3_url_filter", "op8_warc"):
        assert sorted(r.page_id for r in got) == sorted(p[0] for p in pages)
    elif name == "op1_pack":
        assert collections.Counter(r.doc_id for r in got if r.piece == 0) == collections.Counter(r[0] for r in rows)
    elif name == "op4_license_scan":
        assert [(rows[r.doc_id][1][r.start : r.stop], r.license) for r in got] == [("Licensed under the MIT License", "MIT")]
    else:
        assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)


def test_near_duplicates_of_long_texts_and_of_repeated_ids(spark):
    near = " ".join([*LONG.split()[:-3000], "other", "words"])
    far = " ".join(LONG.split()[:30_000])
    short = "two texts under one id are judged by their words"
    rows = [(1, LONG), (2, near), (3, far), (4, re.sub("[a-z]", lambda m: m[0].upper(), LONG)), (5, short), (5, near), (6, short.upper() + "!")]
    got = collections.defaultdict(set)
    for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].add(r.class_id)
    a, b = bag(LONG), bag(near)
    both = sum((a & b).values())
    assert both / (sum(a.values()) + sum(b.values()) - both) >= 0.8
    assert got == {1: {1}, 2: {1}, 3: {3}, 4: {1}, 5: {1, 5}, 6: {5}}


def test_long_texts_and_urls(spark):
    urls = [(1, "http://" + "a." * 5000 + "com/en/x"), (2, "http://b.net/" + "y" * 200_000), (3, "http://c.org/es/" + "z" * 50_000)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert [got[k].rule for k in (1, 2, 3)] == ["com/en/", None, "org/es/"] and got[1].host == "a." * 5000 + "com" and len(got[2].path) == 200_001
    english, german = "the of and to thing with", "der die und nicht schen ung"
    rows = [(k, " ".join(R.choice((english, german)[k % 2].split()) for _ in range(30)), ("en", "de")[k % 2]) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs, docs.doc_id.isNotNull())
    long = spark.createDataFrame([(1, (german + " ") * 40_000), (2, (english + " ") * 40_000 + german)], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.identify(long, model, ["doc_id"]).orderBy("doc_id").collect()] == ["de", "en"]
    at_end = spark.createDataFrame([(1, "x " * 500_000 + "mail me@here.org")], "doc_id long, text string")
    assert pii.find(at_end).first().spans == "email:1000005:1000016"


def test_personal_data_of_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "me@here.org"), (1, "me@here.org"), (1, "me@here.org"), (2, None)], "doc_id long, text string").selectExpr("*", "'x' AS spans", "1 AS n_email")
    rows = pii.find(docs).collect()
    assert collections.Counter((r.doc_id, r.spans) for r in rows) == {(None, "email:0:11"): 1, (1, "email:0:11"): 2, (2, ""): 1}
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.filter("text = '<email>'").count() == 3
    assert pii.find(docs.limit(0)).count() == pii.redact(docs.limit(0)).count() == 0


def test_stages_on_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    none = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    bench = spark.read.parquet(f"{path}/benchmark.parquet")
    for out in (near_dedup.keep_first(none), language_id.keep_identified(none), decontamination.clean(spark, none, bench), pii.redact(none)):
        assert out.columns == none.columns and out.count() == 0
    none.write.parquet(f"{tmp_path}/documents.parquet")
    bench.limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names_come_back_as_they_were(spark):
    text = say(30, R)
    docs = spark.createDataFrame(rows_of([text, text + " and more", None]), DOCS).selectExpr("*", "1 AS class_id", "2 AS row_number", "3 AS hits_", "4 AS n_words", "5 AS items", "6 AS cuts", "'k' AS node", "7 AS label")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    for out in (near_dedup.keep_first(docs), decontamination.clean(spark, docs, bench), pii.redact(docs)):
        assert out.columns == docs.columns and {(r.class_id, r.n_words, r.label) for r in out.collect()} <= {(1, 4, 7)}
    packed = packing.pack(spark, docs.selectExpr("*", "1 AS piece", "2 AS offset", "3 AS uid", "4 AS sequence_id"))
    assert packed.count() == 3 and packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_digests_of_the_query_are_those_of_the_words(spark, folder):
    path, rows, _ = folder
    got = {(r.doc_id, r.n_words): r for r in registered.queries()["op2_decontaminate"](spark, path).collect()}
    r = got[(4, len(words(rows[4][1])))]
    assert r.contaminated and r.n_hit == r.n_words and r.items_sha256 == hashlib.sha256(b"1").hexdigest()
