"""Kernels on masks of a few pixels, mostly against plain loops over random ones."""

import itertools
import math
from types import SimpleNamespace

import numpy as np
import pytest

from vellum.operators import images as I
from vellum.operators import routing
from vellum.plans.images import glyphs

RANDOM = [np.random.default_rng(seed).random((9 + seed % 5, 8 + seed % 7)) < (0.15, 0.3, 0.5, 0.7)[seed % 4] for seed in range(24)]


def mask(points, h=14, w=14):
    m = np.zeros((h, w), bool)
    for x, y in points:
        m[y, x] = True
    return m


def inked(m):
    return {(x, y) for y, x in zip(*m.nonzero(), strict=True)}


def touching(p, of):
    """Pixels around p; a diagonal one only where neither pixel beside both is there."""
    x, y = p
    straight = {q for q in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)) if q in of}
    corners = {(x + a, y + b) for a in (-1, 1) for b in (-1, 1) if (x + a, y + b) in of and (x + a, y) not in of and (x, y + b) not in of}
    return straight | corners


def flooded(cells, beside):
    """Connected parts by flood fill, as sets."""
    left, parts = set(cells), []
    while left:
        part, edge = set(), {left.pop()}
        while edge:
            part |= edge
            edge = {q for p in edge for q in beside(p) if q in left}
            left -= edge
        parts.append(part)
    return parts


def eight(p):
    return [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def four(p):
    return [(p[0] + a, p[1] + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]


@pytest.mark.parametrize("m", RANDOM)
def test_roles_are_numbers_of_neighbours(m):
    points = inked(m)
    s = I.Skeleton.of(m)
    for p in points:
        n = len(touching(p, points))
        assert s.role(p) == ("isolated", "endpoint", "path")[n] if n < 3 else s.role(p) == "junction"
    clusters = flooded(s.having("junction"), eight)
    assert sorted(map(sorted, clusters)) == sorted(sorted(c) for c in s.clusters())


@pytest.mark.parametrize("m", RANDOM)
def test_paths_walk_every_edge_once(m):
    points = inked(m)
    edges = {frozenset((p, q)) for p in points for q in touching(p, points)}
    s = I.Skeleton.of(m)
    of = {p: k for k, c in enumerate(s.clusters()) for p in c}
    paths = s.paths()
    walked = [frozenset(e) for p in paths for e in itertools.pairwise(p["points"])]
    inside = {e for e in edges if len({of.get(p) for p in e}) == 1 and next(iter(e)) in of}
    assert len(walked) == len(set(walked)) and set(walked) == edges - inside
    assert I.Skeleton(sorted(points, reverse=True)).paths() == paths
    for p in paths:
        assert all(s.role(q) == "path" for q in p["points"][1:-1])
        assert math.isclose(p["length"], sum(math.dist(a, b) for a, b in itertools.pairwise(p["points"])))


@pytest.mark.parametrize("m", RANDOM)
def test_parts_and_holes_by_flood_fill(m):
    label, n = I.components(m)
    parts = flooded(inked(m), eight)
    assert n == len(parts) and all(len({label[y, x] for x, y in part}) == 1 for part in parts) and (label > 0).sum() == m.sum()
    h, w = m.shape
    closed = [c for c in flooded(inked(~m), four) if all(0 < x < w - 1 and 0 < y < h - 1 for x, y in c)]
    assert sorted(I.holes(m, 1)) == sorted(map(len, closed)) and sorted(I.holes(m, 3)) == sorted(len(c) for c in closed if len(c) > 2)
    kept = I.without_small(m, 4)
    assert inked(kept) == set().union(*(p for p in parts if len(p) >= 4))


@pytest.mark.parametrize("m", RANDOM)
def test_thinning_keeps_parts_and_goes_no_further(m):
    wide = np.kron(m, np.ones((3, 3), bool))
    thin = I.thinned(wide)
    assert not (thin & ~wide).any() and (I.thinned(thin) == thin).all()
    for part in flooded(inked(wide), eight):
        left = inked(thin) & part
        assert len(flooded(left, eight)) <= 1 and (len(left) < len(part) or len(part) < 4)


def test_a_short_end_joins_what_goes_on_straight():
    trunk = {(9, y) for y in range(2, 13)} | {(x, 9) for x in range(2, 9)}  # an arm from the left, an end of three pixels below
    merged = I.merged_spurs(I.Skeleton(trunk).paths(), short=6)
    assert [len(p["merged"]) for p in merged].count(1) == 1 and len(merged) == 2
    assert max(merged, key=lambda p: len(p["points"]))["length"] >= 9
    # two ways ahead that turn equally much: the end stays by itself
    fork = {(6, y) for y in (6, 7, 8)} | {(6 - k, 6 - k) for k in range(1, 6)} | {(6 + k, 6 - k) for k in range(1, 6)}
    alone = I.merged_spurs(I.Skeleton(fork).paths(), max_angle=80)
    assert not any(p["merged"] for p in alone) and sum(p["short"] for p in alone) == 1


def test_layers_share_no_pixel_and_pale_edges_need_ink_beside_them():
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (30, 40, 3)).astype(np.uint8)
    image[::3] = 255
    m = I.color_masks(image)
    names = ("red", "blue", "green", "unknown", "black")
    assert sum(m[k].astype(int) for k in names).max() == 1 and all(m[k].any() for k in names)
    plain = I.color_masks(image, recover=False)
    for name in ("red", "blue", "green"):
        assert not plain[f"recovered_{name}"].any() and (m[name] == plain[name] | m[f"recovered_{name}"]).all()
        for x, y in inked(m[f"recovered_{name}"]):
            assert any(q in inked(plain[name]) for q in four((x, y)))
    assert not any(m[k][::3].any() for k in names)  # paper
    strong = {"red": (30, 30, 200), "blue": (210, 40, 40), "green": (50, 180, 50), "black": (20, 25, 30)}
    for name, bgr in strong.items():
        assert I.color_masks(np.full((2, 2, 3), bgr, np.uint8))[name].all()


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_bridges_against_a_plain_search(radius):
    for k, target in enumerate(RANDOM):
        donor = np.random.default_rng(100 + k).random(target.shape) < 0.5
        ink = inked(target)
        want = {(x, y) for x, y in inked(donor) if any(all(any((x + s * a * d, y + s * b * d) in ink for d in range(1, radius + 1)) for s in (1, -1)) for a, b in ((1, 0), (0, 1), (1, 1), (1, -1)))}
        assert inked(I.bridges(target, donor, radius)) == want


def test_thresholds():
    gray = np.full((8, 8), 220, np.uint8)
    gray[2:4, 2:6] = 30
    want = gray == 30
    assert (I.ink(gray) == want).all() and (I.ink(255 - gray) == want).all() and (I.ink(gray, "fixed", 100) == want).all()
    with pytest.raises(ValueError):
        I.ink(gray, "other")


def test_repairs():
    stroke = mask({(x, 6) for x in range(1, 13)})
    clean = I.hypotheses(stroke)
    assert [h["tool"] for h in clean if h["selected"]] == ["original"]
    broken = stroke.copy()
    broken[6, 6:8] = False
    before = broken.copy()
    found = I.hypotheses(broken)
    best = next(h for h in found if h["selected"])
    assert best["tool"] != "original" and I.components(best["mask"])[1] == 1 and (broken == before).all()
    apart = mask({(x, 3) for x in range(1, 6)} | {(9, y) for y in range(7, 13)})
    assert (I.bridged_ends(apart) == apart).all()


def test_equal_masks_are_worked_once(spark):
    shapes = [(14, 14, 30), (14, 14, 1), (7, 28, 5)]  # the last has the bytes of the first
    square = np.zeros((14, 14), np.uint8)
    square[3:9, 4:10] = 255
    data = {0: square.tobytes(), 1: np.roll(square, 2).tobytes(), 2: square.tobytes()}
    rows = [(100 * k + i, h, w, bytearray(data[k])) for k, (h, w, n) in enumerate(shapes) for i in range(n)]
    masks = spark.createDataFrame([*rows, (999, 4, 4, bytearray(16))], "id long, height int, width int, data binary").repartition(5)
    worked = spark.sparkContext.accumulator(0)

    def kernel(m):
        worked.add(1)
        return [(k, len(m), int(y.sum())) for k, y in enumerate(m) if y.any()]  # none for the empty one

    schema = "row int, height int, ink int"
    want = sorted(map(tuple, I.per_mask(masks, kernel, schema).collect()))
    assert worked.value == len(rows) + 1 and len({r[0] for r in want}) == len(rows)
    assert sorted(map(tuple, I.per_distinct_mask(masks, kernel, schema).collect())) == want
    assert worked.value == len(rows) + 1 + 4


def test_glyphs_against_a_plain_drawing(spark):
    t = SimpleNamespace(spark=spark)
    for s in (1, 2, 6, 9, 13, 14, 50):
        t.part = spark.range(1, 64).selectExpr("id AS p_partkey", f"{s} AS p_size")
        found = {r["id"]: bytes(r["data"]) for r in glyphs(t).collect()}
        for k in range(1, 64):
            top, left, bottom, right = s % 3 + 1, k % 3 + 1, 12 - k % 2, 12 - s % 2

            def inked(y, x):
                side = top <= y <= bottom and (y == top or (y == bottom and k % 4 != 1) or x == left or (x == right and k % 3 != 2))
                return left <= x <= right and (side or (k % 5 == 0 and y == 7 and x != s % 14)) and not (k % 7 == 3 and x == left and y in (6, 7))

            assert found[k] == bytes(255 * inked(y, x) for y in range(14) for x in range(14))
    assert not glyphs(t).schema["data"].nullable  # else a join draws them in the scan, to test that


def ring(side=40, low=12, high=28):
    return mask({(x, y) for x in range(low, high) for y in range(low, high) if not (low + 2 <= x < high - 2 and low + 2 <= y < high - 2)}, side, side)


def test_every_routed_repair_exists():
    assert {tool for tools in routing.REPAIRS.values() for tool in tools} <= set(I.REPAIRS) == set(I._REPAIR) and len(I.REPAIRS) == 11
    for m in (np.zeros((5, 6), bool), np.ones((9, 12), bool), mask({(3, 3)})):
        assert all(repair(m).shape == m.shape and I.hypotheses(m) for repair in I._REPAIR.values())


def test_lines_and_stamps_go():
    glyph = ring()
    line = mask({(x, 20) for x in range(2, 38)}, 40, 40)
    cleaned = I.without_line(glyph | line)
    assert not (cleaned & line & ~I.dilated(glyph, 2)).any() and (cleaned & glyph).sum() >= 0.8 * glyph.sum()
    slanted = mask({(x, 10 + x // 2) for x in range(2, 38)}, 40, 40)
    cleaned = I.without_line(glyph | slanted)
    assert (cleaned & slanted & ~I.dilated(glyph, 2)).sum() <= 8 and (cleaned & glyph).sum() >= 0.8 * glyph.sum()
    edge = mask({(x, 3) for x in range(4, 17)}, 40, 40)
    assert (I.without_stamp(glyph | edge) == glyph).all()
    assert any((h["mask"] == glyph).all() and h["accepted"] == (h["tool"] != "linear_artifact_removal") for h in I.hypotheses(glyph | edge)[1:])
    assert "linear_artifact_removal" in {h["tool"] for h in I.hypotheses(glyph | line)}


def test_normalized_median_and_border():
    block = mask({(x, y) for x in range(2, 12) for y in range(2, 12)}, 14)
    holed, speck = block.copy(), block.copy()
    holed[6, 6], speck[0, 13] = False, True
    assert (I.normalized(holed) == block).all() and (I.normalized(speck) == block).all()
    assert I.median(holed)[6, 6] and not I.median(speck)[0, 13]
    bar = mask({(x, 6) for x in range(1, 9)}, 14)
    assert sorted(zip(*(I.continued_border(bar) & ~bar).nonzero(), strict=True)) == [(y, x) for y in (5, 6, 7) for x in range(3) if (y, x) not in {(6, 1), (6, 2)}]
    assert all((I.continued_border(np.rot90(bar, k)) == np.rot90(I.continued_border(bar), k)).all() for k in range(4))


def test_every_damage_of_the_survey():
    assert {"bleed_through", "edge_crop_loss", "threshold_failure", "compression_artifacts", "ink_overlap"} < set(I.DAMAGES) and len(I.DAMAGES) == 10
    glyph = ring()
    for recipe, (_, least, most) in I._TRIED.items():
        done = [I.damaged(glyph, recipe, seed) for seed in range(20)]
        share = [(d ^ glyph).sum() for d in done]
        assert all(c == 0 or least <= c <= most * glyph.sum() for c in share) and sum(c > 0 for c in share) >= 15, recipe
        if recipe in ("bleed_through", "ink_overlap"):
            assert all((d & glyph == glyph).all() for d in done)
        if recipe == "edge_crop_loss":
            assert all((d & ~glyph).sum() == 0 for d in done)
        assert (I.damaged(np.zeros((6, 6), bool), recipe, 1) == 0).all() and I.damaged(mask({(3, 3)}), recipe, 1).shape == (14, 14)


def test_vertical_fragments_group_by_column():
    lines = mask({(10, y) for y in (*range(5, 30), *range(40, 60))} | {(14, y) for y in range(70, 85)} | {(60, y) for y in range(5, 20)} | {(x, 90) for x in range(40)}, 100, 100)
    groups, found = I.vertical_groups(lines)
    assert [(g["center_x"], g["fragments"], g["y1"], g["y2"], g["total_height"], g["structural"]) for g in groups] == [(11, 3, 5, 85, 60, True), (60, 1, 5, 20, 15, False)]
    assert found[5:30, 8:15].all() and not found[30:40].any() and not found[:, 15:].any()
    assert (I.vertical_lines(lines) == (lines & (np.arange(100) != 90)[:, None])).all()


def test_characters():
    two = mask({(x, y) for x in (*range(1, 6), *range(8, 13)) for y in range(4, 10)})
    assert len(I.character_parts(two)) == 2
    joined = two.copy()
    joined[6, 6:8] = True
    assert len(I.character_parts(joined)) == 1
    mark = two.copy()
    mark[1, 2:4] = True
    assert len(I.character_parts(mark)) == 2 and I.character_parts(mark)[0][0] == 1
    assert I.character_parts(np.zeros((4, 4), bool)) == []


def test_augmentation_is_reproducible():
    m = mask({(x, y) for x in range(3, 10) for y in range(3, 10)})
    for recipe in I.DAMAGES:
        _, seed = I.seed_of("a", recipe, 0, 1)
        assert (I.damaged(m, recipe, seed) == I.damaged(m, recipe, seed)).all()
    assert I.seed_of("a", "blur", 0, 0) != I.seed_of("a", "blur", 1, 0)
    with pytest.raises(ValueError):
        I.damaged(m, "other", 1)


def test_features_are_ordered_and_small_parts_go():
    m = mask({(x, 3) for x in range(1, 9)} | {(12, 12)})
    f = I.features(m)
    assert list(f) == sorted(f) and f["components"] == 2
    assert I.components(I.without_small(m, 3))[1] == 1
    assert I.micro_components(m)[0] == {"id": 1, "x1": 1, "y1": 3, "x2": 9, "y2": 4, "ink": 8, "density": 1.0, "aspect": 8.0}
    assert I.quality(np.full((5, 5), 7, np.uint8)) == {"blur": 0.0, "brightness": 7.0, "contrast": 0.0}
    wave = np.array([3, 1, 3, 1, 3])
    assert len(wave) == 5 and I.symbols(m).startswith("P0:EE:8")
