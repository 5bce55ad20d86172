"""Operators on hand-written rows: edge cases that the tables don't hold."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import columns as C
from vellum.operators import fusion, joins, language_model, layout, metrics, models, profiles, routing, rules, sequences, splits


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_percent_rounds_half_to_even(spark):
    r = one(spark, *[C.percent(F.lit(n), F.lit(d)).alias(f"c{k}") for k, (n, d) in enumerate([(1, 8), (3, 8), (0, 0), (5, 4)])])
    assert tuple(r) == (12, 38, 0, 125)


def test_words_and_keys(spark):
    r = one(spark, C.normalized(F.lit(" «Բարեւ-ներ»՝ ")).alias("a"), C.normalized(F.lit("և"), True).alias("b"), C.ngrams(F.lit("ab"), 3).alias("c"), C.unknown_letters(F.lit("aбa1"), "ab").alias("d"), C.slug(F.lit("??")).alias("e"), C.canonical(F.lit("2.50")).alias("f"), C.canonical(F.lit(True)).alias("g"), C.suffix_hints(F.lit("Գրիգորյան"), C.SURNAME_SUFFIXES).alias("h"), C.as_int(F.lit("x"), 7).alias("i"), C.seed(F.lit("f" * 64)).alias("j"))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.i) == ("բարեւներ", "եվ", ["^^a", "^ab", "ab$"], ["1", "б"], "unknown", "2.5000", "true", 7)
    assert [(h.suffix, h.start, h.stop) for h in r.h] == [("յան", 6, 9)] and int(r.j) == 2**64 - 1


def test_natural_order(spark):
    rows = spark.createDataFrame([("b10",), ("B2",), ("a",), ("10",), ("9",)], "s string")
    assert [r.s for r in rows.orderBy(C.natural_key(F.col("s"))).collect()] == ["9", "10", "a", "B2", "b10"]


def test_boxes(spark):
    b = C.box(F.lit(9), F.lit(8), F.lit(1), F.lit(2))
    r = one(spark, b.alias("b"), C.box(F.lit(None).cast("int"), F.lit(1), F.lit(2), F.lit(3)).alias("n"), C.padded(b, 3, 10, 10).alias("p"))
    assert tuple(r.b) == (1, 2, 9, 8) and r.n is None and tuple(r.p) == (0, 0, 10, 10)


@pytest.mark.parametrize(("scores", "want"), [((0.45, 0.45, 0.9), "mixed"), ((0.45, 0.25, 0.0), "mixed"), ((0.45, 0.24, 0.0), "printed_only"), ((0.44, 0.45, 0.0), "handwriting_only"), ((0.0, 0.0, 0.65), "empty_or_noise"), ((0.0, 0.0, 0.64), "review")])
def test_visual_classes(spark, scores, want):
    assert one(spark, routing.visual_class(*map(F.lit, scores)).alias("v")).v == want


@pytest.mark.parametrize(("w", "h", "d", "n", "want"), [(351, 10, 0.5, 1, "oversized_group"), (50, 10, 0.5, 1, "horizontal_line_like_group"), (10, 40, 0.5, 1, "vertical_line_like_group"), (6, 10, 0.1, 1, "tiny_isolated_group"), (14, 14, 0.8, 1, "small_dense_blob"), (16, 16, 0.5, 2, "small_dense_square_blob"), (16, 16, 0.5, 3, None), (30, 30, 0.2, 3, "small_hollow_square_blob"), (30, 30, 0.2, 4, None), (100, 40, 0.3, 9, None)])
def test_line_filter(spark, w, h, d, n, want):
    assert one(spark, routing.reject_reason(*map(F.lit, (w, h, d, n))).alias("r")).r == want


def test_corrections(spark):
    box = "struct<x1:int,y1:int,x2:int,y2:int>"
    blues = spark.createDataFrame([(1, 1, (10, 10, 60, 30)), (1, 2, (300, 300, 340, 320))], f"doc int, id_a int, a {box}")
    reds = spark.createDataFrame([(1, 11, (5, 18, 70, 22)), (1, 12, (70, 10, 110, 30)), (1, 13, (500, 10, 510, 20)), (2, 14, (10, 10, 60, 30))], f"doc int, id_b int, b {box}")
    deleted, found = joins.corrections(blues, reds)
    assert [tuple(r) for r in deleted.collect()] == [(1, 1, 1)]
    assert [(r.id_a, r.id_b, r["rank"]) for r in found.collect()] == [(1, 12, 1)]


def test_near_finds_each_pair_once(spark):
    rng = random.Random(3)
    boxes = [(0, k, (x, y, x + rng.randint(1, 200), y + rng.randint(1, 200))) for k in range(40) for x, y in [(rng.randint(-100, 400), rng.randint(0, 400))]]
    box = "struct<x1:int,y1:int,x2:int,y2:int>"
    got = joins.near(spark.createDataFrame(boxes, f"doc int, id_a int, a {box}"), spark.createDataFrame(boxes, f"doc int, id_b int, b {box}"), ["doc"], 20)
    pairs = sorted((r.id_a, r.id_b) for r in got.collect())
    gap = lambda a, b: (max(0, max(a[0], b[0]) - min(a[2], b[2])) ** 2 + max(0, max(a[1], b[1]) - min(a[3], b[3])) ** 2) ** 0.5
    assert pairs == sorted((i, j) for _, i, a in boxes for _, j, b in boxes if gap(a, b) <= 20)


def test_json_difference(spark):
    rows = [(1, '{"a": 1, "b": [1, 2], "c": {"d": null}}', '{"a": "1", "b": [1], "c": {"d": null, "e": 2}}'), (2, "{}", "{}"), (3, None, '{"x": 1}'), (4, "not json", "{}")]
    got = {(r.id, r.path): r.status for r in joins.json_difference(spark.createDataFrame(rows, "id long, before string, after string")).collect()}
    assert got == {(1, "$.a"): "type_changed", (1, "$.b[1]"): "removed", (1, "$.c.e"): "added", (3, "$.x"): "added", (4, "$"): "type_changed"}
    many = [(1, "[]", str(list(range(400))))]
    rows = joins.json_difference(spark.createDataFrame(many, "id long, before string, after string")).collect()
    assert len(rows) == 300 and rows[0].total == 401


def test_profiles_rank_a_matching_class_first(spark):
    long = [(c, s, "holes", v, s) for c, n in (("A", 9), ("B", 1)) for s, v in enumerate(["1"] * n + ["0"] * (10 - n))]
    profile = profiles.distributions(spark.createDataFrame(long, "class string, sample int, feature string, value string, seq int"))
    observed = spark.createDataFrame([(1, "holes", "1"), (2, "holes", "new"), (3, "other", "1")], "obs int, feature string, value string")
    importance = spark.createDataFrame([("holes", "high")], "feature string, importance string")
    got = {(r.obs, r["class"]): r for r in profiles.likelihoods(observed, profile, importance).collect()}
    assert got[(1, "A")]["rank"] == 1 and got[(1, "A")].likelihood > got[(1, "B")].likelihood
    assert abs(sum(r.likelihood for (o, _), r in got.items() if o == 1) - 1) < 1e-9
    assert got[(2, "A")].likelihood == pytest.approx(0.5) and (3, "A") not in got
    assert profiles.likelihoods(observed, profile.limit(0), importance).count() == 0
    # ties go to the value seen first
    tie = profiles.modes(profiles.distributions(spark.createDataFrame([("A", 0, "f", "x", 5), ("A", 1, "f", "y", 2)], "class string, sample int, feature string, value string, seq int"))).first()
    assert (tie.value, tie.percent) == ("y", 50)


def test_beams_equal_exhaustive_search(spark):
    rng = random.Random(1)
    positions = [[("", -0.65)] if k == 2 else [(c, rng.randint(0, 64) / 64) for c in rng.sample("abcde", 3)] for k in range(4)]
    text = ",".join("array(" + ",".join(f"struct(1 as nth, '{c}' as char, cast({s} as double) as score)" for c, s in p) + ")" for p in positions)
    got = spark.sql(f"select array({text}) as p").select(fusion.beams(F.col("p")).alias("b")).first().b
    every = sorted(((sum(s for _, s in c), "".join(x for x, _ in c)) for c in itertools.product(*positions)), key=lambda x: (-x[0], len(x[1]), x[1]))[:12]
    assert [(b.text, round(b.total, 9)) for b in got] == [(t, round(s, 9)) for s, t in every]


def test_backup_strings(spark):
    r = one(spark, fusion.parsed_backups(F.lit("l:a,b:b,b:b|b:x,b:y||l:,b:|\nl:c,l:d,zz")).alias("p")).p
    assert [(x.selected, x.chars) for x in r] == [("a", ["a", "b"]), ("x", ["x", "y"]), ("d", ["d", "c"])]


def test_fusion_caps_and_orders(spark):
    rows = [(1, "a", "s1", 0.7, 2), (1, "a", "s2", 0.6, None), (1, "b", "s1", 0.9, 1), (1, "", "s1", 1.0, 1), (1, "c", None, 0.9, 3)]
    got = fusion.fused(spark.createDataFrame(rows, "p int, char string, source string, score double, rank int"), ["p"]).orderBy("place").collect()
    assert [(r.char, round(r.score, 6), r.best_rank, r.sources) for r in got] == [("a", 1.0, 2, 2), ("b", 0.9, 1, 1), ("c", 0.9, 3, 1)]


def test_ctc_blanks_and_repeats(spark):
    steps = [(1, k, t, 0.5) for k, t in enumerate([0, 3, 3, 0, 3, 2, 2, 0])] + [(2, 0, 0, 0.1)]
    got = sequences.decoded(spark.createDataFrame(steps, "unit int, step int, token int, confidence double"), ["unit"]).orderBy("index").collect()
    assert [(r.token, r.start, r.stop) for r in got] == [(3, 1, 2), (3, 4, 4), (2, 5, 6)]


def test_extrema_and_spacing(spark):
    wave = spark.createDataFrame([(1, i, float(y)) for i, y in enumerate([3, 1, 1, 3, 1, 3])], "u int, i long, y double")
    got = sequences.extrema(wave, ["u"]).orderBy("i").collect()
    assert [(r.i, r.kind, r.prominence) for r in got] == [(1, "min", 2.0), (3, "max", 2.0), (4, "min", 2.0)]
    assert sequences.extrema(wave.withColumn("y", F.col("i").cast("double")), ["u"]).count() == 0
    r = spark.sql("select array(named_struct('weight', 1.0D, 'i', 1L), named_struct('weight', 3.0D, 'i', 3L), named_struct('weight', 1.0D, 'i', 6L), named_struct('weight', 1.0D, 'i', 7L)) as c").select(sequences.spaced(F.col("c"), 3).alias("s")).first().s
    assert [(x.i, x.weight) for x in r] == [(3, 3.0), (6, 1.0)]


def test_smoothing_pads_with_zeros(spark):
    rows = sequences.smoothed(spark.createDataFrame([(1, i, 5.0) for i in range(3)], "u int, i int, y double"), ["u"]).orderBy("i").collect()
    assert [r.smooth for r in rows] == [3.0, 3.0, 3.0]


def test_rules_cover_each_branch(spark):
    base = {"loops": 0, "endpoints": 2, "junctions": 0, "top_contact": False, "bottom_contact": False, "aspect": 1.0, "horizontal": 0.0, "vertical": 0.0, "diagonal": 0.0, "curve": 0.0, "phase": 0, "line_removed": False, "bridge_required": False, "bridge_completed": False}
    cases = [base, base | {"loops": 2, "junctions": 4, "endpoints": 5, "aspect": 0.0}, base | {"bridge_required": True, "aspect": 1.35, "curve": 0.35}]
    rows = spark.createDataFrame([(k, *c.values()) for k, c in enumerate(cases)], "id int, loops int, endpoints int, junctions int, top_contact boolean, bottom_contact boolean, aspect double, horizontal double, vertical double, diagonal double, curve double, phase int, line_removed boolean, bridge_required boolean, bridge_completed boolean")
    facts = {k: {(r.predicate, r.argument) for r in rules.derive(rows).collect() if r.id == k} for k in range(3)}
    assert facts[0] == {("family", "no_loop"), ("family", "two_endpoint"), ("has_structure", "normal_path_exit_count"), ("family", "unbranched"), ("family", "compact")}
    assert ("family", "complex_loop_branch_endpoint") in facts[1] and ("warning", "multi_loop_complexity") in facts[1] and not {("family", a) in facts[1] for a in ("wide", "tall", "compact")} - {False}
    assert {("selection_risk", "unsafe_reconstruction_candidate"), ("family", "wide"), ("family", "curve_rich")} <= facts[2]
    assert [r.passes for r in rules.fired(rows).collect()] == [2, 2, 2]


def test_rules_over_facts_against_a_plain_loop(spark):
    from pyspark.sql import functions as F

    from vellum.plans.structure import CHAIN

    def run(row, chain, most):
        known, fires, passes = [], 0, 0
        while passes < most:
            passes, before = passes + 1, len(known)
            for _, condition, states, *needs in chain:
                if condition(row) and all(x in known for x in (needs[0] if needs else [])):
                    fires += 1
                    known += [x for x in states if x not in known]
            if len(known) == before:
                break
        return sorted(known), fires, passes

    plain = {"true": lambda r: True, "endpoints >= 2": lambda r: r[1] >= 2, "aspect >= 0.5": lambda r: r[2] >= 0.5, "loops = 0": lambda r: r[3] == 0, "loops >= 1": lambda r: r[3] >= 1}
    rows = [(k, k % 4, (k % 5) / 4, k % 3) for k in range(60)]
    signatures = spark.createDataFrame(rows, "id int, endpoints int, aspect double, loops int")
    for most in (1, 2, 3, 4, 9):
        got = {r.id: (sorted(r.known), r.fires, r.passes) for r in rules.chained(signatures, CHAIN, most).collect()}
        assert got == {r[0]: run(r, [(n, plain[c], *x) for n, c, *x in CHAIN], most) for r in rows}
    alone = [r for r in CHAIN if not r[3:]]
    slow = rules.chained(signatures, [*alone, ("never", "false", ["x:y"], ["x:z"])])
    key = lambda df: sorted((r.id, sorted(r.known), sorted(r.said), r.fires, r.passes) for r in df.collect())
    assert key(rules.chained(signatures, alone)) == key(slow)
    given = rules.chained(signatures, CHAIN, given=F.array(F.lit("mark:odd")))
    assert all("mark:odd" in r.known for r in given.collect())


def test_capped_grouping():
    import numpy as np

    chain = np.array([[k * 50, 0, k * 50 + 40, 20, False, False] for k in range(12)], object)
    sizes = sorted(np.bincount(layout.grouped(chain)).tolist())[-3:]
    assert max(sizes) <= 6  # a chain stops at the largest group's width
    dot = np.array([[0, 10, 40, 30, False, False], [18, 0, 22, 4, True, False], [300, 0, 304, 4, True, False]], object)
    root = layout.grouped(dot)
    assert root[0] == root[1] != root[2]
    wide = np.array([[0, 0, 200, 5, False, True], [0, 6, 40, 20, False, False]], object)
    assert len(set(layout.grouped(wide))) == 2


def belong(a, b, s):
    """Whether two components belong together, said plainly."""
    left, right = (a, b) if a[0] <= b[0] else (b, a)
    heights = [x[3] - x[1] for x in (a, b)]
    centres = abs((a[1] + a[3]) / 2 - (b[1] + b[3]) / 2)
    ratio = max(heights) / max(min(heights), 1)
    if a[4] != b[4]:
        large = a if b[4] else b
        apart = [max(0, max(a[k], b[k]) - min(a[k + 2], b[k + 2])) for k in (0, 1)]
        return not large[5] and apart[0] <= s.satellite_gap[0] and apart[1] <= s.satellite_gap[1] and centres <= s.satellite_center and ratio <= s.satellite_ratio
    if any((a[4], b[4], a[5], b[5])):
        return False
    gap, over = right[0] - left[2], max(0, min(a[3], b[3]) - max(a[1], b[1])) / max(min(heights), 1)
    size = [max(a[k + 2], b[k + 2]) - min(a[k], b[k]) for k in (0, 1)]
    return -max(a[2] - a[0], b[2] - b[0]) <= gap <= s.max_gap and centres <= s.y_tolerance and over >= s.min_overlap and ratio <= s.max_height_ratio and size[0] <= s.max_pair[0] and size[1] <= s.max_pair[1]


def test_grouping_against_a_plain_loop():
    import numpy as np

    rng, s = np.random.default_rng(6), layout.Grouping()
    for _ in range(12):
        n = 60
        x, y = rng.integers(0, 500, n), rng.integers(0, 260, n)
        boxes = [(int(a), int(b), int(a + rng.integers(2, 70)), int(b + rng.integers(2, 50)), bool(rng.random() < 0.25), bool(rng.random() < 0.15)) for a, b in zip(x, y, strict=True)]
        order = sorted(range(n), key=lambda i: (boxes[i][1], boxes[i][0], i))
        group, box = list(range(n)), [b[:4] for b in boxes]
        for k, i in enumerate(order):
            for j in order[k + 1 :]:
                if boxes[j][1] - boxes[i][3] > s.y_window:
                    break
                p, q = group[i], group[j]
                if not belong(boxes[i], boxes[j], s) or p == q:
                    continue
                one = (min(box[p][0], box[q][0]), min(box[p][1], box[q][1]), max(box[p][2], box[q][2]), max(box[p][3], box[q][3]))
                if one[2] - one[0] <= s.max_group[0] and one[3] - one[1] <= s.max_group[1]:
                    box[p], group = one, [p if g == q else g for g in group]
        assert layout.grouped(np.array(boxes, object)).tolist() == group


def test_split_contract(spark):
    rows = [(c, f"{c}{s}", v) for c in range(3) for s in range(10) for v in range(5)]
    out = splits.stratified(spark.createDataFrame(rows, "class int, source string, variant int"))
    assert out.count() == 150 and out.groupBy("source").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    counts = {(r["class"], r.split): r.n for r in out.groupBy("class", "split").agg(F.countDistinct("source").alias("n")).collect()}
    assert counts == {(c, s): n for c in range(3) for s, n in (("train", 8), ("validation", 1), ("test", 1))}
    for bad in ([(1, "a", 0), (2, "a", 0), (1, "b", 0), (1, "c", 0)], [(1, "a", 0), (1, "b", 0)]):
        with pytest.raises(Exception, match="two labels|too few sources"):
            splits.stratified(spark.createDataFrame(bad, "class int, source string, variant int")).collect()


def test_metrics_without_hits(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "c")], "truth string, said string")
    got = {r["class"]: (r.precision, r.recall, r.f1) for r in metrics.per_class(rows).collect()}
    assert got == {"a": (0.0, 0.0, 0.0), "b": (0.0, 0.0, 0.0), "c": (1.0, 1.0, 1.0)}
    m = metrics.memory([("x", 2.0, metrics.confusion(rows, True)), ("y", 1.0, metrics.confusion(rows))]).collect()
    assert [(r.predicted, r.true, r.weighted, r.share, r.sources) for r in m] == [("b", "a", 6.0, 1.0, "x,y")]


def test_repairs_replace_one_or_two_letters(spark):
    tokens = spark.createDataFrame([(1, "cat", 0, 0.2, "b", 0.5), (1, "cat", 2, 0.1, "r", 0.4), (1, "cat", 2, 0.1, "t", 0.9)], "token int, text string, position int, held double, char string, confidence double")
    got = sorted((r.repaired, r.changes) for r in language_model.candidates(tokens).collect())
    assert got == [("bar", 2), ("bat", 1), ("car", 1)]


def test_models(spark):
    rows = spark.createDataFrame([(k, k % 2, [float(k % 2), float(k)]) for k in range(40)], "id int, class int, vector array<double>")
    model = models.forest(rows, trees=5)
    assert models.predicted(model, rows, "id").filter("said <> class").count() == 0
    assert models.importances(model, ["a", "b"])[0][0] == "a"
    with pytest.raises(ValueError):
        models.forest(rows.filter("class = 1"))
    f = F.create_map(F.lit("b"), F.lit(2.0), F.lit("a"), F.lit(1.0), F.lit("z"), F.lit(0.0))
    assert one(spark, models.ordered(f, ["a", "b"]).alias("v")).v == [1.0, 2.0]
    with pytest.raises(Exception, match="missing feature: q"):
        spark.range(1).select(models.ordered(f, ["q"]).alias("v")).collect()
    failed = models.Expert("x", lambda c: c.withColumn("scores", F.lit(None).cast("array<double>")), enabled=True).run(spark.range(1).select(F.col("id").alias("crop_id")), ["a"]).first()
    assert failed.status == "failed" and failed.candidates == []
