"""Preparation kernels over the invented glyphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vellum.operators import borders
from vellum.operators import images as I
from vellum.operators import preparation as P

from .images import _INK, glyphs
from .registry import query


@query("i2_turned_margins", f"WITH {_INK} SELECT id, greatest(min(13 - y) - 2, 0) AS x1, greatest(min(x) - 2, 0) AS y1, least(max(13 - y) + 3, 14) AS x2, least(max(x) + 3, 14) AS y2 FROM g GROUP BY id")
def turned_margins(t):
    """Boxes of the ink, with room around it, after a quarter turn."""
    return I.per_mask(glyphs(t), lambda m: [P.margins(P.quarter_turned(m, 90), 2)], "x1 bigint, y1 bigint, x2 bigint, y2 bigint")


@query("i2_prepared_pages")
def prepared_pages(t):
    """Angle, box and ink of each glyph as a page that is cleaned, laid level and cropped."""

    def kernel(m):
        page, angle, box = P.prepared(np.where(m, 30, 220).astype(np.uint8), 180, strength=5, block=9, below=10, padding=2)
        return [(angle, *box, int((page == 0).sum()))]

    return I.per_distinct_mask(glyphs(t), kernel, "angle double, x1 int, y1 int, x2 int, y2 int, ink int")


@query("i5_printed_masks", f"""WITH {_INK}, n AS (SELECT *, x - row_number() OVER (PARTITION BY id, y ORDER BY x) AS run FROM g), r AS (SELECT id, y, x FROM (SELECT *, count(*) OVER (PARTITION BY id, y, run) AS long FROM n) WHERE long < 8),
k AS (SELECT r.id, r.y, r.x FROM r WHERE EXISTS (FROM r o WHERE o.id = r.id AND abs(o.y - r.y) <= 1 AND abs(o.x - r.x) <= 1 AND (o.y <> r.y OR o.x <> r.x))),
c AS (SELECT id, y, x FROM k UNION SELECT a.id, a.y, a.x + 1 FROM k a JOIN k b ON a.id = b.id AND a.y = b.y AND b.x = a.x + 2)
SELECT id, count(*) AS ink, sum(y * 14 + x)::BIGINT AS places FROM c GROUP BY id""")
def printed_masks(t):
    """Ink for printed text: without long horizontal runs and specks, gaps of a pixel closed."""

    def kernel(m):
        ys, xs = np.nonzero(P.printed_mask(m, P.horizontal_lines(m, 8)))
        return [(len(ys), int((ys * 14 + xs).sum()))] if len(ys) else []

    return I.per_mask(glyphs(t), kernel, "ink bigint, places bigint")


@query("i9_masked_crops", f"""WITH {_INK}, b AS (SELECT id, greatest(min(x) - 1, 0) AS x1, greatest(min(y) - 1, 0) AS y1, least(max(x) + 2, 14) AS x2, least(max(y) + 2, 14) AS y2 FROM g GROUP BY id)
SELECT b.*, count(*) FILTER (y < 5 OR x < 5) AS shown, count(*) FILTER (y < 5) AS upper FROM g JOIN b USING (id) GROUP BY ALL""")
def masked_crops(t):
    """Crops to the ink in which two of three masks stay visible, and one alone."""

    def kernel(m):
        image, ys, xs = np.where(m, 0, 255).astype(np.uint8), *np.indices(m.shape)
        masks = {"upper": m & (ys < 5), "left": m & (xs < 5), "rest": m & (ys >= 5) & (xs >= 5)}
        both, box = P.masked_crop(image, masks, P.margins(m, 1), ("upper", "left", "absent"))
        return [(*box, int((both == 0).sum()), int((P.masked_crop(image, masks, box, ("upper",))[0] == 0).sum()))]

    return I.per_mask(glyphs(t), kernel, "x1 bigint, y1 bigint, x2 bigint, y2 bigint, shown bigint, upper bigint")


@query("i16_recognition_crops", f"WITH {_INK} SELECT id, 82::BIGINT AS height, 82::BIGINT AS width, 9 * count(*) AS dark, 4 * count(*) AS fitted FROM g GROUP BY id")
def recognition_crops(t):
    """Light glyphs on black as dark ones on white, enlarged and framed, and in a square of 28."""

    def kernel(m):
        light = m.astype(np.uint8) * 255
        big = P.for_recognition(light)
        return [(*big.shape, int((big == 0).sum()), int((P.fitted(P.dark_on_white(light), 28) == 0).sum()))]

    return I.per_mask(glyphs(t), kernel, "height bigint, width bigint, dark bigint, fitted bigint")


@query("i18_bin_features", f"""WITH {_INK}, w AS (SELECT DISTINCT id, unnest(range(0, 7)) AS bin FROM p), n AS (SELECT id, x // 2 AS bin, y, x FROM g),
c AS (SELECT DISTINCT p.id, p.x // 2 AS bin, p.y, p.x, g.y IS NOT NULL AS on_ FROM p LEFT JOIN g ON p.id = g.id AND p.x = g.x AND p.y = g.y),
v AS (SELECT id, bin, sum((on_ <> above)::INT) AS changes FROM (SELECT *, lag(on_) OVER (PARTITION BY id, x ORDER BY y) AS above FROM c) GROUP BY id, bin),
a AS (SELECT id, bin, count(*) AS k, min(y) AS low, max(y) AS high, avg(y) AS mean FROM n GROUP BY id, bin)
SELECT w.id, w.bin, round(coalesce(k, 0) / 28, 6) AS ink, round(coalesce(low, 0) / 13, 6) AS top, round(coalesce(high, 0) / 13, 6) AS bottom, round(coalesce(mean, 0) / 13, 6) AS centre, round(coalesce(high - low + 1, 0) / 14, 6) AS span, round(coalesce(changes, 0) / 28, 6) AS transitions FROM w LEFT JOIN a USING (id, bin) LEFT JOIN v USING (id, bin)""")
def bin_features(t):
    """Features of seven ranges of columns of each glyph."""
    some = [P.BIN_FEATURES.index(n) for n in ("ink", "top", "bottom", "centre", "span", "transitions")]
    return I.per_mask(glyphs(t), lambda m: [(k, *(round(float(row[j]), 6) for j in some)) for k, row in enumerate(P.bin_features(m, 7))], "bin bigint, ink double, top double, bottom double, centre double, span double, transitions double")


@query("i8_stacked_splits", f"""WITH {_INK}, n AS (SELECT id, y, count(g.x) AS k FROM (SELECT DISTINCT id, y FROM p) LEFT JOIN g USING (id, y) GROUP BY ALL),
s AS (SELECT *, (k + coalesce(lag(k) OVER u, 0) + coalesce(lead(k) OVER u, 0)) / 3 AS smooth FROM n WINDOW u AS (PARTITION BY id ORDER BY y)),
b AS (SELECT id, arg_min(y, smooth * 100 + y / 100) AS split, min(smooth) AS low FROM s WHERE y BETWEEN 4 AND 9 GROUP BY id),
r AS (SELECT b.id, split, low, max(smooth) AS top, avg(smooth) AS mean, sum(k) FILTER (y < split) AS above, sum(k) FILTER (y >= split) AS below FROM b JOIN s USING (id) GROUP BY ALL),
j AS (SELECT *, CASE WHEN least(above, below) < 6 THEN 'one_side_has_too_little_ink' WHEN low / greatest(1.0, top) > 0.3 AND low / greatest(1.0, mean) > 0.75 THEN 'no_strong_horizontal_valley' ELSE 'horizontal_projection_valley' END AS reason FROM r)
SELECT id, CASE WHEN reason = 'horizontal_projection_valley' THEN split END AS split, reason FROM j""")
def stacked_splits(t):
    """Where each glyph would come apart as two stacked lines."""
    return I.per_mask(glyphs(t), lambda m: [P.split_row(m, 4, 3, 6, 0.3, 0.75)], "split bigint, reason string")


_QUALITY = f"""WITH {_INK}, v AS (SELECT p.id, list((CASE WHEN g.id IS NULL THEN 0 ELSE 255 END)::DOUBLE ORDER BY p.i) AS v FROM p LEFT JOIN g ON p.id = g.id AND p.x = g.x AND p.y = g.y GROUP BY p.id),
l AS (SELECT id, v[i + 1] AS c, v[abs(y - 1) * 14 + x + 1] + v[(13 - abs(12 - y)) * 14 + x + 1] + v[y * 14 + abs(x - 1) + 1] + v[y * 14 + (13 - abs(12 - x)) + 1] - 4 * v[i + 1] AS lap FROM v JOIN (SELECT i, i // 14 AS y, i % 14 AS x FROM range(0, 196) r(i)) ON true)
SELECT id, round(var_pop(lap), 2) AS blur, round(avg(c), 2) AS brightness, round(stddev_pop(c), 2) AS contrast FROM l GROUP BY id"""


@query("a30_image_quality", _QUALITY)
def image_quality(t):
    """Blur, brightness and contrast of each glyph."""
    names = ("blur", "brightness", "contrast")
    return I.per_mask(glyphs(t), lambda m: [tuple(I.quality(m.astype(np.uint8) * 255)[n] for n in names)], ", ".join(f"{n} double" for n in names))


_PARTS = f"""WITH RECURSIVE {_INK}, e AS (SELECT a.id, a.y * 14 + a.x AS a, b.y * 14 + b.x AS b FROM g a JOIN g b ON a.id = b.id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
l(id, pos, least_) AS (SELECT id, y * 14 + x, y * 14 + x FROM g UNION SELECT e.id, e.b, l.least_ FROM l JOIN e ON l.id = e.id AND l.pos = e.a WHERE l.least_ < e.b),
c AS (SELECT id, pos // 14 AS y, pos % 14 AS x, min(least_) AS part FROM l GROUP BY id, pos),
k AS (SELECT id, part, count(*) AS ink, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM c GROUP BY id, part)"""


@query("p17_image_conditions", f"""{_PARTS}, n AS (SELECT id, count(*) AS parts, count(*) FILTER (ink <= 3) AS small, sum(ink) AS ink, bool_or(x1 = 0 OR y1 = 0 OR x2 = 14 OR y2 = 14) AS border FROM k GROUP BY id),
d AS (SELECT id, CASE WHEN ink <= 2 THEN 'unknown' WHEN small >= 2 AND ink / 196 < 0.18 THEN 'scanner_noise' WHEN border THEN 'edge_crop_loss' WHEN parts > 1 THEN 'light_cut' ELSE 'clean' END AS damage FROM n)
SELECT id, CASE damage WHEN 'clean' THEN 'clean' ELSE 'uncertain' END AS condition, damage NOT IN ('clean', 'scanner_noise') AS repair, damage, CASE damage WHEN 'unknown' THEN 0.3 WHEN 'scanner_noise' THEN 0.35 WHEN 'edge_crop_loss' THEN 0.4 WHEN 'light_cut' THEN 0.38 ELSE 0.72 END::DOUBLE AS confidence FROM d""")
def image_conditions(t):
    """What the pixels of each glyph tell of damage, worn down so that some fall apart."""
    return I.per_mask(glyphs(t), lambda m: [P.condition(np.where(m, 0, 255).astype(np.uint8))[:4]], "condition string, repair boolean, damage string, confidence double")


@query("b29_border_profiles", f"""WITH {_INK}, u AS (SELECT id, count(*) FILTER (x <= 5) AS a, count(*) FILTER (x > 6) AS b FROM g GROUP BY id),
m AS (SELECT id, count(*) AS matched FROM (SELECT id, y FROM g WHERE x IN (4, 5) GROUP BY ALL INTERSECT SELECT id, y FROM g WHERE x IN (7, 8) GROUP BY ALL) GROUP BY id)
SELECT u.id, 1::BIGINT AS gap, 1.0::DOUBLE AS overlap, coalesce(matched, 0) AS matched, CASE WHEN coalesce(matched, 0) < 2 THEN 'profiles_do_not_align' END AS blocked FROM u LEFT JOIN m USING (id)""")
def border_profiles(t):
    """What speaks for joining a glyph's left part to its right one, a column apart."""
    limits = borders.Limits(tolerance=0)

    def kernel(m):
        e = borders.edge(m, {"id": 1, "box": (0, 0, 6, 14), "groups": 1}, {"id": 2, "box": (7, 0, 14, 14), "groups": 1}, "right", limits)
        return [(e["gap"], e["overlap"], e["matched"], e["blocked"])]

    return I.per_mask(glyphs(t), kernel, "gap bigint, overlap double, matched bigint, blocked string")


@query("j10_attached_units", f"""WITH {_INK}, q AS (SELECT id, x > 6 AS r, y > 6 AS d, y, x FROM g WHERE x <> 6 AND y <> 6),
h AS (SELECT id, d, count(*) >= 2 AS joined FROM (SELECT id, d, y FROM q WHERE x IN (4, 5) GROUP BY ALL INTERSECT SELECT id, d, y FROM q WHERE x IN (7, 8) GROUP BY ALL) GROUP BY ALL),
v AS (SELECT id, r, count(*) >= 2 AS joined FROM (SELECT id, r, x FROM q WHERE y IN (4, 5) GROUP BY ALL INTERSECT SELECT id, r, x FROM q WHERE y IN (7, 8) GROUP BY ALL) GROUP BY ALL),
n AS (SELECT i.id, (SELECT count(*) FROM h WHERE h.id = i.id AND joined) AS across, (SELECT count(*) FROM v WHERE v.id = i.id AND joined) AS down FROM (SELECT DISTINCT id FROM g) i)
SELECT id, 4 - least(3, across + down) AS units, least(3, across + down) AS accepted FROM n""")
def attached_units(t):
    """Quarters of each glyph that belong together by their borders; four edges join three at most."""
    limits = borders.Limits(tolerance=0)
    quarters = [{"id": 2 * r + c, "box": (7 * c, 7 * r, 6 + 8 * c, 6 + 8 * r), "groups": 1, "layer": "black"} for r in (0, 1) for c in (0, 1)]

    def kernel(m):
        units, accepted, _ = borders.attached(m, quarters, limits)
        return [(len(units), len(accepted))]

    return I.per_mask(glyphs(t), kernel, "units bigint, accepted bigint")
