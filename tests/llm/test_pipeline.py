"""The pipeline, stage by stage, against plain versions of its decisions."""

import itertools
import random

import pytest

import corpus_pipeline
from vellum.llm import queries as registered
from vellum.llm.common import store

from .test_text_operators import LANGS, bag, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, out = random.Random(6), tmp_path_factory.mktemp("tables")
    texts = []
    for k in range(40):
        lang = list(LANGS)[k % 4]
        said = [rng.choice(LANGS[lang].split()) + rng.choice(LANGS[lang].split()) for _ in range(60)]
        texts.append((" ".join(said), lang))
    passage = " ".join(f"q{k}" for k in range(15))
    texts += [texts[3], (texts[4][0] + " end", texts[4][1]), (texts[5][0][:200] + f" {passage} " + texts[5][0][200:], texts[5][1]), ("12 !! 34", "en"), (None, "fr"), (texts[6][0] + " mail a.b@c.org", texts[6][1]), (passage, "en")]
    rows = [(k, t, g, f"src{k % 3}", len(t or "")) for k, (t, g) in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows, passage


def classes(rows):
    """The least id of each row's class: pairs of similarity 0.8, connected."""
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(rows, 2):
        x, y = bag(a[1]), bag(b[1])
        both = sum((x & y).values())
        if both >= 0.8 * (sum(x.values()) + sum(y.values()) - both):
            p, q = sorted((find(a[0]), find(b[0])))
            parent[q] = p
    return {r[0]: find(r[0]) for r in rows}


def test_stages(spark, folder):
    path, rows, passage = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, path), "test")
        assert docs.columns == columns, name
        seen.append({r.doc_id: r for r in docs.collect()})
    language, near, clean, redacted = seen
    letters = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert {r[0] for r in letters} - set(language) <= {46} and not set(language) - {r[0] for r in letters}
    kept = [r for r in letters if r[0] in language]
    assert set(near) == {k for k, c in classes(kept).items() if k == c}
    for k, r in near.items():
        if passage in r.text:
            assert k not in clean or passage not in clean[k].text
        else:
            assert clean[k].text == r.text and clean[k].n_chars == r.n_chars
    assert all(set(words(passage)).isdisjoint(words(r.text)) for r in clean.values())
    assert set(redacted) == set(clean) and all("a.b@c.org" not in r.text for r in redacted.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert {r.doc_id for r in packed.collect()} == set(redacted)


def test_run_equals_its_stages(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, path), "test")
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, path).select(*keys)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.select(*keys).collect()))


def test_registered_names(spark):
    names = registered.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(registered.oracle_sql()) <= set(names)


def test_stored_results_can_be_released(spark, folder):
    from vellum.llm import common
    from vellum.sources import durable

    kept = store(spark.range(3).selectExpr("id"), "release")
    assert kept.count() == 3
    common.release(spark)
    assert not durable._stored
    assert store(spark.range(2).selectExpr("id"), "release").count() == 2
