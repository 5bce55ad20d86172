"""Preparation kernels against plain versions."""

import itertools

import numpy as np
import pytest

from vellum.operators import images as I
from vellum.operators import preparation as P

RNG = np.random.default_rng(3)


def page(h=90, w=120):
    gray = np.full((h, w), 230, np.uint8)
    for y in range(20, h - 15, 12):
        gray[y : y + 3, 15 : w - 15] = 25
    return gray


def test_quarter_turns():
    image = RNG.integers(0, 256, (5, 8)).astype(np.uint8)
    assert P.quarter_turned(image, 90)[0].tolist() == image[::-1, 0].tolist()
    back = image
    for _ in range(4):
        back = P.quarter_turned(back, 90)
    assert (back == image).all() and (P.quarter_turned(P.quarter_turned(image, 90), 270) == image).all()
    with pytest.raises(ValueError):
        P.quarter_turned(image, 45)


@pytest.mark.parametrize("angle", [-6.0, -2.5, 3.0, 7.25])
def test_skewed_pages_are_laid_level(angle):
    level = page()
    askew = P.turned(level, angle)
    found = P.skew(askew < 128)
    assert abs(found + angle) <= 0.5 and P.skew(level < 128) == 0.0
    again = P.turned(askew, found)
    inner = (slice(20, -20), slice(25, -25))
    assert (np.abs(again[inner].astype(int) - level[inner]) > 100).mean() < 0.05
    assert (P.turned(level, 0.1) == level).all() and (P.turned(level, 30) == level).all()
    assert P.skew(np.zeros((4, 4), bool)) == 0.0


def test_turning_samples_between_pixels():
    image = RNG.integers(0, 256, (9, 11)).astype(np.uint8)
    out, a = P.turned(image, 8.0), np.radians(8.0)
    for y, x in itertools.product(range(9), range(11)):
        sy = min(max(4 + np.sin(a) * (x - 5) + np.cos(a) * (y - 4), 0), 8)
        sx = min(max(5 + np.cos(a) * (x - 5) - np.sin(a) * (y - 4), 0), 10)
        near = sum(image[j, i] * max(0, 1 - abs(j - sy)) * max(0, 1 - abs(i - sx)) for j in range(9) for i in range(11))
        assert abs(int(out[y, x]) - near) <= 0.51


def test_noise_falls_and_edges_stay():
    clean = page(60, 60)
    noisy = np.clip(clean + RNG.normal(0, 8, clean.shape), 0, 255).astype(np.uint8)
    done = P.denoised(noisy, strength=12)
    assert np.abs(done.astype(int) - clean).mean() < 0.6 * np.abs(noisy.astype(int) - clean).mean()
    assert (P.denoised(clean) == clean).mean() > 0.95
    # every weight by hand, in the middle of a small image
    g = RNG.integers(0, 256, (9, 9)).astype(np.uint8)
    f = g.astype(float)
    total = weights = 0.0
    for dy, dx in itertools.product(range(-1, 2), repeat=2):
        far = np.mean([(f[4 + j, 4 + i] - f[4 + j + dy, 4 + i + dx]) ** 2 for j in range(-1, 2) for i in range(-1, 2)])
        weight = np.exp(-far / 400)
        total, weights = total + weight * f[4 + dy, 4 + dx], weights + weight
    assert abs(int(P.denoised(g, 20, patch=3, search=3)[4, 4]) - total / weights) <= 0.51


def test_local_threshold_follows_the_light():
    light = np.linspace(60, 240, 80)[None, :].repeat(40, axis=0)
    gray = light.copy()
    gray[18:21, 5:75] -= 50
    found = P.locally_thresholded(gray.astype(np.uint8), block=15, below=14)
    assert found[18:21, 8:72].all() and not found[:8].any()
    g = RNG.integers(0, 256, (12, 12)).astype(np.uint8)
    sigma = 0.3 * ((5 - 1) * 0.5 - 1) + 0.8
    w = np.exp(-np.add.outer(np.arange(-2, 3) ** 2, np.arange(-2, 3) ** 2) / (2 * sigma**2))
    got = P.locally_thresholded(g, 5, 3)
    for y, x in itertools.product(range(2, 10), range(2, 10)):
        mean = (g[y - 2 : y + 3, x - 2 : x + 3] * w).sum() / w.sum()
        assert got[y, x] == (g[y, x] <= round(mean) - 3)


def test_margins_and_prepared():
    assert P.margins(np.zeros((4, 6), bool)) == (0, 0, 6, 4)
    mask = np.zeros((50, 60), bool)
    mask[10:20, 30:33] = True
    assert P.margins(mask, 5) == (25, 5, 38, 25) and P.margins(mask, 100) == (0, 0, 60, 50)
    out, angle, (x1, y1, x2, y2) = P.prepared(P.quarter_turned(page(), 90), 270, padding=4)
    assert angle == 0.0 and out.shape == (y2 - y1, x2 - x1) and set(np.unique(out)) == {0, 255}
    assert (x1, y1, x2, y2) == (11, 16, 109, 72 + 3)


@pytest.mark.parametrize("size", [(2, 1), (3, 1), (1, 2), (2, 3)])
def test_closing_fills_what_a_box_cannot_enter(size):
    w, h = size
    for _ in range(20):
        m = RNG.random((8, 9)) < 0.4
        wide = np.pad(m, 4)
        free = np.zeros_like(wide)
        for y, x in itertools.product(range(wide.shape[0] - h + 1), range(wide.shape[1] - w + 1)):
            if not wide[y : y + h, x : x + w].any():
                free[y : y + h, x : x + w] = True
        if h == 1 or w == 1:
            assert (P.closed(m, w, h) == ~free[4:-4, 4:-4]).all()
        assert not (m & ~P.closed(m, w, h)).any()


def test_printed_mask_drops_lines_and_specks():
    m = np.zeros((12, 30), bool)
    m[6, :] = True
    m[2, 3] = True
    m[9, 5:8], m[9, 9:12], m[1:4, 20] = True, True, True
    out = P.printed_mask(m, P.horizontal_lines(m, 20))
    assert not out[6].any() and not out[2, 3] and out[9, 5:12].all() and out[1:4, 20].all()
    assert (P.printed_mask(m, vertical=I.vertical_lines(m, 3))[:4, 20] == 0).all()


def test_crops_and_layers():
    image = RNG.integers(0, 200, (10, 12, 3)).astype(np.uint8)
    a, b = RNG.random((10, 12)) < 0.3, RNG.random((10, 12)) < 0.3
    crop, box = P.masked_crop(image, {"a": a, "b": b}, (-3, 2, 7, 40), ("a", "b", "none"))
    assert box == (0, 2, 7, 10) and crop.shape == (8, 7, 3)
    shown = (a | b)[2:10, 0:7]
    assert (crop[shown] == image[2:10, 0:7][shown]).all() and (crop[~shown] == 255).all()
    one, two = np.full((4, 4), 255, np.uint8), np.full((4, 4), 255, np.uint8)
    one[1], two[:, 1] = 10, 90
    both = P.composed({"one": one, "two": two}, ("one", "two", "three"))
    assert both[1, 1] == 90 and both[1, 0] == 10 and both[0, 1] == 90 and both[0, 0] == 255
    assert P.composed({}, ("x",), one) is one
    with pytest.raises(ValueError):
        P.composed({}, ("x",))


def test_recognition_input():
    gray = np.full((4, 6), 240, np.uint8)
    gray[1:3, 2:4] = 15
    for image in (gray, 255 - gray):
        out = P.for_recognition(image, 2, 5)
        assert out.shape == (18, 22) and (out == 0).sum() == 16 and (out[0] == 255).all() and (out[7:11, 9:13] == 0).all()
    assert (P.for_recognition(np.full((3, 3), 255, np.uint8)) == 255).all()


@pytest.mark.parametrize("shape", [(7, 20), (20, 7), (9, 9), (3, 4)])
def test_fitted_is_the_mean_over_areas(shape):
    gray = RNG.integers(0, 256, shape).astype(np.uint8)
    out, side = P.fitted(gray, 10), 10
    h, w = shape
    nh, nw = max(int(h * (side / max(h, w))), 1), max(int(w * (side / max(h, w))), 1)
    y0, x0 = (side - nh) // 2, (side - nw) // 2
    fine = np.kron(gray.astype(float), np.ones((nh, nw)))  # as many fine rows in a pixel as there will be pixels
    want = fine.reshape(nh, h, nw, w).mean(axis=(1, 3))
    assert np.abs(out[y0 : y0 + nh, x0 : x0 + nw] - want).max() <= 0.51
    frame = out.copy()
    frame[y0 : y0 + nh, x0 : x0 + nw] = 255
    assert (frame == 255).all()


def test_bins_and_splits():
    assert P.column_bins(10, 4) == [(0, 2), (2, 5), (5, 8), (8, 10)] and P.column_bins(2, 4)[1] == (0, 1)
    m = np.zeros((44, 30), bool)
    m[3:18, 4:26], m[24:40, 4:26] = True, True
    assert P.split_row(m) == (19, "horizontal_projection_valley")
    assert P.split_row(m[:20])[1] == "too_short_for_two_rows" and P.split_row(m[:36])[1] == "no_valid_search_band"
    assert P.split_row(np.ones((44, 30), bool))[1] == "no_strong_horizontal_valley"
    top = m.copy()
    top[20:] = False
    assert P.split_row(top)[1] == "one_side_has_too_little_ink"
    f = P.bin_features(m, 3)
    assert f.shape == (3, 10) and abs(f[1][0] - 31 / 44) < 1e-9 and f[1][8] == 4 / 44


def test_conditions_in_order():
    def seen(m):
        return P.condition(np.where(m, 20, 255).astype(np.uint8))

    m = np.zeros((30, 30), bool)
    assert seen(m)[2] == "unknown" and P.condition(None)[3] == 0.15
    m[10:20, 10:14] = True
    assert seen(m)[:5] == ("clean", False, "clean", 0.72, 0.0)
    apart = m.copy()
    apart[10:20, 18:20] = True
    assert seen(apart)[2] == "light_cut"
    edge = m.copy()
    edge[0:15, 12] = True
    assert seen(edge)[2] == "edge_crop_loss"
    specks = m.copy()
    specks[3, 3] = specks[25, 25] = True
    assert seen(specks)[1:3] == (False, "scanner_noise") and "fragmented_components" in seen(specks)[5]
    dark = P.condition(np.where(m, 240, 0).astype(np.uint8))
    assert dark[2] == "clean"


def test_equal_pages_are_prepared_once(spark):
    """Pages took tens of milliseconds for each row, though glyphs repeat."""
    from types import SimpleNamespace

    from vellum.plans import images, preparation

    t = SimpleNamespace(spark=spark, part=spark.range(1, 5).selectExpr("explode(array(id, id + 420)) AS p_partkey", "cast(id AS int) AS p_size"))
    drawn = {r["id"]: np.frombuffer(r["data"], np.uint8).reshape(14, 14) for r in images.glyphs(t).collect()}
    want = set()
    for k, m in drawn.items():
        page, angle, box = P.prepared(np.where(m > 0, 30, 220).astype(np.uint8), 180, strength=5, block=9, below=10, padding=2)
        want.add((k, angle, *box, int((page == 0).sum())))
    pages = preparation.prepared_pages(t)
    assert {tuple(r) for r in pages.collect()} == want and len(want) == 8
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("MapInPandas") :]
