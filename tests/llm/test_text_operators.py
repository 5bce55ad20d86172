"""Decontamination, packing, language ID, near-duplicates and scores against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from vellum.llm import decontamination, language_id, lm_scoring, near_dedup, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, hits int, rank int, kept_id long"
R = random.Random(5)
VOCAB = ["".join(R.choice("abcdeéñtßü") for _ in range(R.randint(1, 8))) for _ in range(300)]


def say(n, rng=R):
    return " ".join(rng.choice(VOCAB) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def words(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s))


def rows_of(texts, lang="en"):
    return [(k, t, lang, "s", len(t or ""), 0.5, "x", 1, 2, 3) for k, t in enumerate(texts)]


BASE = [say(R.randint(1, 120)) for _ in range(60)]
TEXTS = BASE + [None, "", " \n\t", "word", "A b C d", "!!! ... 12", BASE[0], BASE[0].upper(), say(9000), "İ ́é <|endoftext|> it's"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(TEXTS) + [(None, "no id", None, None, None, None, None, None, None, None), (3, BASE[3], "en", "s", 1, 0.1, "x", 1, 2, 3)], DOCS).repartition(3)


def test_decontamination_against_brute_force(spark, docs):
    items = [(1, BASE[5]), (2, say(30)), (3, "word"), (10, BASE[7][:80]), (4, None), (5, ""), (6, BASE[5]), (None, BASE[8]), (7, BASE[9].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in decontamination.judge(spark, docs, bench).collect()}
    for k, text in enumerate(TEXTS):
        w, hit, found = words(text), set(), set()
        for item, t in items:
            iw = words(t)
            if item is None or not iw:
                continue
            n = min(10, len(iw))
            wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found.add(item)
        r = got[(k, len(w))]
        assert (r.n_hit, r.n_items, r.contaminated) == (len(hit), len(found), bool(hit)), k
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def test_decontamination_in_blocks_equals_one_block(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(k, BASE[k]) for k in range(8)], "item_id long, text string")
    whole = sorted(map(tuple, decontamination.judge(spark, docs, bench).collect()), key=str)
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 10)
    assert sorted(map(tuple, decontamination.judge(spark, docs, bench).collect()), key=str) == whole


def test_decontamination_index_is_bounded():
    for texts in ([say(9000)], ["a b " * 20000], ["word"] * 3000, ["x " * k for k in range(1, 12)] * 50, [None, "", "!"]):
        index = decontamination._Index(list(enumerate(texts)), 10)
        assert index.nbytes() <= decontamination.BYTES_PER_CHAR * sum(len((t or "").encode()) + 1 for t in texts) + (1 << 20) * len(index.by_length) + 8 * len(texts)


def test_decontamination_cuts_spans_and_keeps_clean_documents(spark):
    passage = say(20)
    docs = spark.createDataFrame(rows_of([BASE[1], f"alpha beta {say(60)} {passage} gamma", passage]), DOCS)
    out = {r.doc_id: r for r in decontamination.clean(spark, docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert set(out) == {0, 1} and out[0].text == BASE[1]
    assert out[1].text.startswith("alpha beta") and out[1].text.endswith("gamma") and out[1].n_chars == len(out[1].text)
    assert " ".join(words(passage)) not in " ".join(words(out[1].text))


def test_empty_tables(spark, docs):
    none, bench = docs.limit(0), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.judge(spark, none, bench).count() == 0
    assert not decontamination.judge(spark, docs, bench).filter("contaminated").count()
    assert packing.pack(spark, none).count() == 0
    assert near_dedup.classes(none).count() == 0
    assert language_id.identify(none, language_id.learn(none, none.doc_id.isNotNull()), ["doc_id"]).count() == 0
    assert language_id.identify(docs, {"families": []}, ["doc_id"]).filter("lang_pred <> 'und'").count() == 0
    assert lm_scoring.score(none.select("doc_id", "text", language_id.held_out(7, 2).alias("held_out"))).count() == 0


def test_packing_is_whole_and_gapless(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for doc, text in [(k, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (3, BASE[3])]:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[(doc, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()))] += 1
    got = packing.pack(spark, docs).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1


def test_genetic_steps_keep_every_piece():
    rng = random.Random(1)
    lengths = [rng.randint(1, 2047) for _ in range(300)]
    population = packing.first_packings(lengths, 2048, rng, 4)
    first = max(p.score for p in population)
    for p in packing.evolve(population, lengths, 2048, rng, 20):
        assert sorted(i for b in p.bins for i in b) == list(range(300))
        assert all(sum(lengths[i] for i in b) == f <= 2048 for b, f in zip(p.bins, p.fills, strict=True))
    assert max(p.score for p in population) >= first


def test_genetic_steps_beat_best_fit():
    """Where best fit leaves room, crossover saves sequences."""
    for seed in range(3):
        rng = random.Random(seed)
        lengths = [rng.randint(500, 1100) for _ in range(600)]
        population = packing.first_packings(lengths, 2048, rng, 4)
        first = min(len(p.bins) for p in population)
        evolved = packing.evolve(population, lengths, 2048, rng, 60)
        assert len(evolved[0].bins) < first
        assert sorted(i for b in evolved[0].bins for i in b) == list(range(600))


def test_elites_migrate_between_islands(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, k, 0, 0, rng.randint(500, 1100), 0) for k in range(500)]
    states, real = [], packing.store
    monkeypatch.setattr(packing, "store", lambda df, name, **kw: states.append(real(df, name, **kw)) or states[-1])
    packed = packing.pack_rests(spark.createDataFrame(rows, packing.PIECE), 2048, 3, 0)
    sequences = packed.select("sequence").distinct().count()
    best = [{r.island: (-r.n_bins, r.score) for r in s.collect()} for s in states]
    assert len(best) == 3
    for before, after in zip(best[:-1], best[1:], strict=True):
        for island in before:  # an island holds what its neighbour sent, or better
            assert after[island] >= max(before[island], before[(island - 1) % packing.ISLANDS])
    assert sequences == -max(x for x in best[-1].values())[0]
    assert packed.groupBy("sequence").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_packing_by_other_tokenizers(spark, docs, name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    assert packing._cuts_safely(tokenizer) == (name == "word_bpe_49k.json")
    got = collections.Counter((r.doc_id, r.length) for r in packing.pack(spark, docs.filter("doc_id < 20 or doc_id > 60"), path).filter("piece = 0").collect())
    want = collections.Counter((r.doc_id, min(2048, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1)) for r in docs.filter("doc_id < 20 or doc_id > 60").collect())
    assert got == want


def bag(text):
    w = words(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute_classes(texts):
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [bag(t) for t in texts]
    for a, b in itertools.combinations(range(len(texts)), 2):
        if bags[a] and bags[b]:
            both = sum((bags[a] & bags[b]).values())
            if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(k) for k in range(len(texts))]


def edited(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCAB)
    return " ".join(w)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    base = [say(rng.randint(40, 200), rng) for _ in range(12)]
    # groups around the threshold, so that some members only hang on by others
    texts = base + [edited(base[0], rng.randint(1, 9), rng) for _ in range(60)] + [edited(b, 2, rng) for b in base[1:]] + [base[2]] * 5 + [base[3].upper(), None, "", "x", "x", "!"] + ["again " * 50, "again " * 49, "again " * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert [got[k] for k in range(len(texts))] == brute_classes(texts)


def test_one_document_of_a_class_stays(spark, docs):
    out = near_dedup.keep_first(docs)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and 0 in ids and None in ids
    assert TEXTS.index(BASE[0], 1) not in ids
    assert {60, 61, 62} <= set(ids)  # texts without words stay


def test_signatures_are_unbiased_for_weights():
    rng, agree = np.random.default_rng(0), []
    wa = rng.integers(1, 40, 150)
    wb = np.maximum(0, wa + rng.integers(-15, 16, 150))
    for _ in range(60):
        h = rng.integers(1, 2**52, 150).astype(np.uint64)
        on = wb > 0
        s = near_dedup.signatures(np.r_[np.zeros(150, int), np.ones(on.sum(), int)], np.r_[h, h[on]], np.r_[wa, wb[on]], 2)
        agree.append((s[0] == s[1]).mean())
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs(np.mean(agree) - want) < 4 * np.std(agree) / math.sqrt(60)


LANGS = {"en": "the of and to thing with ation er ly", "de": "der die und nicht schen ung keit ein zu", "fr": "le les des eau oi ment que dans ier", "es": "el los ción que ado ar para una mente"}


def test_language_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("".join(rng.sample(v.split(), 2)) if rng.random() < 0.4 else rng.choice(v.split()) for _ in range(40)), g) for k, (g, v) in enumerate(list(LANGS.items()) * 40)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 !! 3", "fr"), (1003, rows[0][1], None), (None, rows[1][1], "de"), (0, rows[0][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", language_id.held_out(4, 2))
    model = language_id.learn(docs, ~docs.held_out & docs.doc_id.isNotNull())
    got = {r.doc_id: r for r in language_id.identify(docs, model, ["doc_id", "held_out"]).collect()}
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0.0
    held = [(got[k].lang_pred, g) for k, _, g in rows[:160] if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(held) > 20 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1003].lang_pred == got[0].lang_pred and not got[None].held_out
    clash = docs.selectExpr("doc_id", "text", "lang", "1 as lang_pred", "2 as score", "'a' as held_out", "3 as read")
    kept = language_id.keep_identified(clash)
    assert kept.columns == clash.columns and kept.count() == docs.count() - 3


@pytest.mark.parametrize("limits", [(3000, 900, 7), (300, 20, 2), (100, 10, 3)])  # of one, five and four levels
def test_scores_against_brute_force(spark, docs, monkeypatch, limits):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows]
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["\0"] for _, t in rows]
    one, two = collections.Counter(), collections.Counter()
    for t, h in zip(tokens, held, strict=True):
        if not h:
            one.update(t)
            two.update(zip(["\1", *t[:-1]], t, strict=True))
    one_of = lambda v: one["\0"] if v == "\1" else one[v]
    n, v = sum(one.values()), len(one)
    learned = []
    real = lm_scoring.learn_weights
    monkeypatch.setattr(lm_scoring, "learn_weights", lambda cells, d: learned.append((cells, real(cells, d))) or learned[-1][1])
    got = lm_scoring.score(docs.select("doc_id", "text", language_id.held_out(7, 2).alias("held_out")), *limits).collect()
    cells, weights = learned[0]
    assert sum(c[1] for c in cells) == n  # every training token was held out once
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all()
    want = collections.Counter()
    for (k, _), t, h in zip(rows, tokens, held, strict=True):
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for a, w in zip(["\1", *t[:-1]], t, strict=True):
            l2, l1, l0 = weights[min(int(one_of(a)).bit_length(), lm_scoring.BUCKETS - 1)]
            score += math.log10(l2 * (two[(a, w)] / one_of(a) if one_of(a) else 0) + l1 * one[w] / n + l0 / (v + 1))
        want[(k, h, len(t), sum(one[w] > 0 for w in t), n, round(base, 6), round(score, 6))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want


def test_weights_prefer_the_better_estimate():
    cells = [(5 * lm_scoring.GRID**2, 100, 100 * 0.5, 100 * 0.001), (7 * lm_scoring.GRID**2 + 1, 100, 0.0, 100 * 0.01)]
    weights = lm_scoring.learn_weights(cells, 1000)
    assert weights[5][0] > 0.9 and weights[7][1] > 0.9 and (weights[6] == weights[5]).all()


def test_every_language_is_learned(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "train", lambda sample: seen.extend(lang for lang, _ in sample) or {"families": []})
    docs = spark.range(230 * 8).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('l', id % 230) AS lang")
    language_id.learn(docs, docs.doc_id.isNotNull())
    assert set(collections.Counter(seen).values()) == {language_id.LEAST_ROWS} and len(set(seen)) == 230


def test_one_row_of_a_class_is_kept(spark):
    long = " ".join(f"word{k}" for k in range(40))
    rows = [(1, long), (1, long), (None, long), (4, "another text of a few words"), (1, "another text of a few words"), (None, "third text with no id at all"), (None, "fourth one with no id either"), (7, long), (8, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.text or "", r.doc_id) for r in near_dedup.keep_first(docs).collect()), key=str)
    assert kept == sorted([(long, 1), ("another text of a few words", 1), ("third text with no id at all", None), ("fourth one with no id either", None), ("", 8), ("", 8)], key=str)
    assert {r.class_id for r in near_dedup.classes(docs.filter(docs.text == long)).collect()} == {1}


def test_near_duplicates_in_small_tiles_and_parts(spark, monkeypatch):
    rng = random.Random(4)
    base = [say(90, rng) for _ in range(3)]
    texts = [edited(b, rng.randint(0, 14), rng) for b in base for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(near_dedup, "TILE", 4)
    monkeypatch.setattr(near_dedup, "PART", 3)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert [got[k] for k in range(len(texts))] == brute_classes(texts)


def tile_of(texts, labels):
    """An Arrow table of one tile in which every text is a member and an odd one."""
    import pyarrow as pa

    data, offsets = near_dedup.utf8_view(pa.array(texts))
    rows, h, w, _ = near_dedup.bags(data, offsets)
    best = near_dedup.signatures(rows, h, w, len(texts))
    n = len(texts)
    names = [b"%016d" % k for k in range(n)]
    table = pa.table({"bucket": [1] * n, "x": [0] * n, "y": [0] * n, "band": [0] * n, "node": names, "label": [names[k] for k in labels], "odd": [False] * n, "bands": list(near_dedup.band_hashes(best)), "marks": [m.tobytes() for m in near_dedup.marks(best)], "text": texts})
    odd = table.set_column(6, "odd", pa.array([True] * n))
    return pa.concat_tables([table, odd]).combine_chunks().to_batches()


def test_a_tile_lets_out_fewer_links_than_classes():
    rng = random.Random(3)
    base = say(200, rng)
    for n in (40, 80):
        texts = [edited(base, 1, rng) for _ in range(n)]  # every pair is similar
        links = [r for b in near_dedup._links(tile_of(texts, range(n))) for r in b.to_pylist()]
        assert len(links) == n - 1
        links = [r for b in near_dedup._links(tile_of(texts, [0] * (n - 1) + [n - 1])) for r in b.to_pylist()]
        assert len(links) == 1
    apart = [say(60, rng) for _ in range(30)]
    assert not list(near_dedup._survivors(tile_of(apart, range(30)))) and not list(near_dedup._links(tile_of(apart, range(30))))


def test_components_by_contraction(spark):
    rng = random.Random(9)
    for links in ([(k, k + 1) for k in range(300)], [(500, k) for k in range(400)], [(rng.randrange(300), rng.randrange(300)) for _ in range(180)], []):
        parent = {x: x for e in links for x in e}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[find(a)] = find(b)
        names = near_dedup.components(spark.createDataFrame(links, "a long, b long"))
        got = {r.node: r.label for r in names.collect()}
        loops = {x for x in parent if all(x not in e or e[0] == e[1] for e in links)}
        assert set(got) == set(parent) - loops
        assert len({(got[x], find(x)) for x in got}) == len(set(got.values())) == len({find(x) for x in got})


def test_requests_grow_as_the_chunks(spark):
    """Each chunk asks in as many rows, however many chunks there are."""
    rng = np.random.default_rng(1)
    per = []
    for n in (4, 16):
        made = []
        for k in range(n):
            words = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 4000))]
            batch = near_dedup.pa.RecordBatch.from_arrays([near_dedup.pa.array([k]), near_dedup.pa.array([False]), near_dedup.pa.array(words)], ["doc_id", "held_out", "text"])
            made += [r | {"chunk": k} for b in lm_scoring._chunks(1)([batch]) for r in b.to_pylist()]
        asked = [r for b in lm_scoring._requests(n, 7)([near_dedup.pa.RecordBatch.from_pylist(made)]) for r in b.to_pylist()]
        per.append(len(asked) / n)
        parted = [lm_scoring._spread(2, n, 7)(g) for _, g in lm_scoring.pd.DataFrame(asked).groupby(["kind", "part", "home"])]
        assert all(len(p) <= 128 for p in parted)
    assert per == [256, 256]
