"""Border profiles, payloads, settings and cuts against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import borders as B
from vellum.operators import records as R


def test_border_places_and_matches():
    rng = np.random.default_rng(1)
    for _ in range(30):
        m, band = rng.random((10, 12)) < 0.3, int(rng.integers(1, 4))
        x1, y1, x2, y2 = 2, 1, 9, 8
        want = {
            "left": [y for y in range(y1, y2) if any(m[y, x] for x in range(x1, x1 + band))],
            "right": [y for y in range(y1, y2) if any(m[y, x] for x in range(x2 - band, x2))],
            "top": [x for x in range(x1, x2) if any(m[y, x] for y in range(y1, y1 + band))],
            "bottom": [x for x in range(x1, x2) if any(m[y, x] for y in range(y2 - band, y2))],
        }
        assert {s: B.touched(m, (x1, y1, x2, y2), s, band) for s in want} == want
    assert B.matched([1, 2, 3], [2, 3, 9], 1) == [(1, 2), (2, 3)] and B.matched([1, 5], [3, 7], 2) == [(1, 3), (5, 7)]
    assert B.matched([], [1], 3) == [] and B.touched(np.ones((3, 3), bool), (5, 5, 9, 9), "left", 1) == []
    with pytest.raises(ValueError):
        B.touched(np.ones((3, 3), bool), (0, 0, 2, 2), "middle", 1)


def unit(k, *box, groups=1, layer="black"):
    return {"id": k, "box": box, "groups": groups, "layer": layer}


def test_units_join_by_their_borders():
    m = np.zeros((40, 60), bool)
    m[10:14, 2:50] = True  # one stroke through three units
    row = [unit(3, 2, 5, 17, 20), unit(1, 18, 5, 33, 20), unit(2, 34, 5, 50, 20)]
    groups, accepted, blocked = B.attached(m, row)
    assert groups == [[1, 2, 3]] and len(accepted) == 2 and not blocked
    assert [(e["first"], e["second"], e["matched"]) for e in accepted] == [(1, 2, 4), (3, 1, 4)] or len({e["gap"] for e in accepted}) == 1
    narrow = B.Limits(most_size=(32, 120))
    groups, accepted, blocked = B.attached(m, row, narrow)
    assert len(groups) == 2 and len(accepted) == 1 and [e["blocked"] for e in blocked] == ["profile_chain_limit_exceeded"]
    apart = [row[0], row[1] | {"layer": "red"}, row[2]]
    assert B.attached(m, apart)[0] == [[3], [1], [2]]
    empty = np.zeros_like(m)
    groups, accepted, blocked = B.attached(empty, row)
    assert len(groups) == 3 and {e["blocked"] for e in blocked} == {"profiles_do_not_align"}
    low = B.attached(m, [unit(1, 2, 5, 17, 20), unit(2, 18, 18, 33, 33)])[2]
    assert [e["blocked"] for e in low] == ["vertical_overlap_too_weak"]
    big = B.attached(m, [unit(1, 2, 5, 17, 20, groups=7), unit(2, 18, 5, 33, 20, groups=6)])[2]
    assert [e["blocked"] for e in big] == ["merged_unit_too_large"]
    below = np.zeros((40, 60), bool)
    below[2:30, 10:14] = True
    assert B.attached(below, [unit(1, 5, 2, 20, 14), unit(2, 5, 15, 20, 30)])[1][0]["direction"] == "down"


def test_cuts_of_heads_against_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(k, *[[round(rng.random(), 2) for _ in range(14)] for _ in range(3)], [rng.random() for _ in range(6)]) for k in range(60)] + [(99, [], [], [], [0.3, 0.7])]
    got = {r.unit: r for r in R.word_cuts(spark.createDataFrame(rows, "unit int, boundary array<double>, bridge array<double>, safety array<double>, length array<double>"), 0.2, 3).collect()}
    for k, boundary, bridge, safety, length in rows:
        expected = length.index(max(length))
        scores = [max(0.0, a - b) * s for a, b, s in zip(boundary, bridge, safety, strict=True)]
        taken = []
        for s, b in sorted((-s, b) for b, s in enumerate(scores) if s >= 0.2):
            if len(taken) < max(0, expected - 1) and all(abs(b - x) >= 3 for x in taken):
                taken.append(b)
        assert (got[k].expected, got[k].confidence, got[k].cuts) == (expected, max(length), sorted(taken))


def test_payloads_by_priority(spark):
    docs = ['{"a": 1}', '{"traced": {}, "auto": {"x": 1}, "observed": {"x": 2}}', '{"observed": "text", "signature": {"y": 3}}', '{"reconstruction": {"selected_scrilog_observation": {"z": 1}}, "metrics": {"scrilog_observation": {"z": 2}}}', '{"manual": {"e": 1}, "expected": {"e": 2}}', '{"metadata": {"crop_geometry": {"w": 1}}, "geometry": {}}']
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, d string").select("k", R.observed_payload(F.col("d")).alias("o"), R.expected_payload(F.col("d")).alias("e"), R.geometry_payload(F.col("d")).alias("g")).orderBy("k").collect()
    assert [r.o for r in rows] == [docs[0], '{"x":1}', '{"y":3}', '{"z":1}', docs[4], docs[5]]
    assert [r.e for r in rows] == [None] * 4 + ['{"e":2}', None] and [r.g for r in rows] == [None] * 5 + ['{"w":1}']


def test_settings_over_defaults(spark):
    given = [{}, {"input_group_mode": "old"}, {"input_group_mode": "old", "input_mode": "new"}, {"crop_padding_px": "7", "other": "1"}, {"crop_padding_px": "many"}]
    made = R.overlaid(F.col("m"), R.REFINER, R.REFINER_ALIASES)
    rows = spark.createDataFrame([(k, m) for k, m in enumerate(given)], "k int, m map<string,string>").select("k", *[c.alias(n) for n, c in made.items()]).orderBy("k").collect()
    assert [r.input_mode for r in rows] == ["scribemap_2_layers", "old", "new", "scribemap_2_layers", "scribemap_2_layers"]
    assert [r.crop_padding_px for r in rows] == [2, 2, 2, 7, 2] and rows[0].asDict() == {"k": 0, **R.REFINER}


def test_features_in_use(spark):
    schema = "names array<string>, vector array<double>, source string, selected_names array<string>, selected_vector array<double>"
    good = [(["a"], [1.0], "reconstructed", ["a"], [2.0]), (["a"], [1.0], "original", None, None), (["a"], [1.0], None, ["b"], [3.0]), ([], [], "reconstructed", ["a"], [4.0])]
    rows = R.active_features(spark.createDataFrame(good, schema)).collect()
    assert [(r.active_source, r.active_vector) for r in rows] == [("reconstructed", [2.0]), ("original", [1.0]), ("original", [1.0]), ("reconstructed", [4.0])]
    for bad in ((["a"], [1.0], "reconstructed", None, None), (["a"], [1.0], "reconstructed", ["b"], [2.0]), (["a"], [1.0], "reconstructed", ["a"], [2.0, 3.0]), (["a"], [1.0], "reconstructed", ["a"], None)):
        with pytest.raises(Exception, match="don't fit"):
            R.active_features(spark.createDataFrame([bad], schema)).collect()


def test_replacements_and_masks(spark):
    cases = list(itertools.product((7, 8, 200), (7, 8, 10, 12)))
    rows = spark.createDataFrame([(w, h) for w, h in cases], "w int, h int").select("w", "h", R.is_replacement(F.col("w"), F.col("h"), F.col("w") * F.col("h")).alias("x")).collect()
    assert all(r.x == (r.w >= 8 and r.h >= 8 and r.w * r.h >= 80 and max(r.w / r.h, r.h / r.w) <= 12) for r in rows)
    kept = spark.createDataFrame([("red",), ("pencil",)], "layer string").select("layer", *[c.alias(k) for k, c in R.crop_masks(F.col("layer")).items()]).collect()
    assert kept[0].context == ["red", "blue", "black"] and kept[1].analysis_mask == ["pencil"]
