"""Kernels over small invented glyphs: one per part, drawn from its key and size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import augmentation
from vellum.operators import images as I

from .registry import query

SIDE = 14


def glyphs(t) -> DataFrame:
    """A frame with a bar, a stem or a gap that the key chooses, as bytes in the JVM."""
    k, s = F.col("p_partkey"), F.col("p_size")
    top, left = s % 3 + 1, k % 3 + 1
    bottom, right = F.lit(SIDE - 2) - k % 2, F.lit(SIDE - 2) - s % 2

    whole = (1 << SIDE) - 1

    def bit(x):
        """The pixel of column x in a row of bits, the first column highest."""
        return F.call_function("shiftleft", F.lit(1), (SIDE - 1 - x).cast("int")).bitwiseAND(whole)

    across = (bit(left - 1) - 1).bitwiseAND(whole).bitwiseAND(F.bitwise_not(bit(right) - 1))
    sides = bit(left).bitwiseOR(F.when(k % 3 != 2, bit(right)).otherwise(0)).bitwiseAND(across)

    def row(y):
        frame = F.when(~F.lit(y).between(top, bottom), 0).when((F.lit(y) == top) | ((F.lit(y) == bottom) & (k % 4 != 1)), across).otherwise(sides)
        if y == 7:
            frame = F.when(k % 5 == 0, frame.bitwiseOR(across.bitwiseAND(F.bitwise_not(bit(s % 14))))).otherwise(frame)
        if y in (6, 7):
            frame = F.when(k % 7 == 3, frame.bitwiseAND(F.bitwise_not(bit(left)))).otherwise(frame)
        return F.lpad(F.bin(F.coalesce(frame, F.lit(0))), SIDE, "0")

    # whole rows as bits: a pixel each costs many times as much
    bits = F.concat(*map(row, range(SIDE)))
    # never null, as Spark knows: else a join on them draws them in the scan to test that
    data = F.coalesce(F.unhex(F.replace(F.replace(bits, F.lit("0"), F.lit("00")), F.lit("1"), F.lit("FF"))), F.lit(b""))
    # kernels cost far more than their bytes: as many tasks as a shuffle has
    keys = t.part.select("p_partkey", "p_size").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return keys.select(k.alias("id"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), data.alias("data"))


_INK = """p AS (SELECT p_partkey AS id, i, i // 14 AS y, i % 14 AS x, p_size % 3 + 1 AS t, p_partkey % 3 + 1 AS l, 12 - p_partkey % 2 AS b, 12 - p_size % 2 AS r, p_partkey AS k, p_size AS s FROM part, unnest(range(0, 196)) u(i)),
g AS (SELECT id, y, x FROM p WHERE (((y = t OR (y = b AND k % 4 <> 1) OR x = l OR (x = r AND k % 3 <> 2)) AND y BETWEEN t AND b AND x BETWEEN l AND r) OR (k % 5 = 0 AND y = 7 AND x BETWEEN l AND r AND x <> s % 14)) AND NOT (k % 7 = 3 AND x = l AND y BETWEEN 6 AND 7))"""


@query("i11_topology")
def topology(t):
    """Parts, ends, junctions, loops and holes of each glyph's skeleton."""
    names = ["components", "endpoints", "junctions", "isolated", "paths", "closed_paths", "holes", "ink", "length"]
    row = lambda found: tuple(float(found[n]) if n == "length" else found[n] for n in names)
    return I.per_mask(glyphs(t), lambda m: [row(I.topology(m))], ", ".join(f"{n} {'double' if n == 'length' else 'int'}" for n in names))


@query("i11_parts_and_holes", f"""WITH RECURSIVE {_INK}, f AS (SELECT DISTINCT p.id, p.y * 14 + p.x AS pos, p.y, p.x FROM p WHERE NOT EXISTS (FROM g WHERE g.id = p.id AND g.y = p.y AND g.x = p.x)),
e AS (SELECT a.id, a.pos AS a, b.pos AS b FROM f a JOIN f b ON a.id = b.id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 UNION ALL SELECT a.id, a.y * 14 + a.x, b.y * 14 + b.x FROM g a JOIN g b ON a.id = b.id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
l(id, pos, least_) AS (SELECT id, pos, pos FROM f UNION SELECT id, y * 14 + x, y * 14 + x FROM g UNION SELECT e.id, e.b, l.least_ FROM l JOIN e ON l.id = e.id AND l.pos = e.a WHERE l.least_ < e.b),
c AS (SELECT id, pos, min(least_) AS part FROM l GROUP BY id, pos),
k AS (SELECT c.id, c.part, count(*) AS n, bool_or(pos < 14 OR pos >= 182 OR pos % 14 IN (0, 13)) AS border, bool_or(f.id IS NULL) AS ink FROM c LEFT JOIN f USING (id, pos) GROUP BY c.id, c.part)
SELECT id, count(*) FILTER (ink) AS parts, count(*) FILTER (NOT ink AND NOT border AND n >= 2) AS holes FROM k GROUP BY id""")
def parts_and_holes(t):
    """8-connected parts of ink, and 4-connected holes of two pixels or more."""
    return I.per_mask(glyphs(t), lambda m: [(I.components(m)[1], len(I.holes(m)))], "parts bigint, holes bigint")


@query("i12_repair_hypotheses")
def repair_hypotheses(t):
    return I.per_distinct_mask(glyphs(t), lambda m: [(h["tool"], h["stage"], h["changed"], h["score"], h["accepted"], h["selected"]) for h in I.hypotheses(m)], "tool string, stage int, changed double, score double, accepted boolean, selected boolean")


@query("i7_micro_components", f"""WITH RECURSIVE {_INK}, e AS (SELECT a.id, a.y * 14 + a.x AS a, b.y * 14 + b.x AS b FROM g a JOIN g b ON a.id = b.id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
l(id, pos, least_) AS (SELECT id, y * 14 + x, y * 14 + x FROM g UNION SELECT e.id, e.b, l.least_ FROM l JOIN e ON l.id = e.id AND l.pos = e.a WHERE l.least_ < e.b),
c AS (SELECT id, pos // 14 AS y, pos % 14 AS x, min(least_) AS part FROM l GROUP BY id, pos),
k AS (SELECT id, part, count(*) AS ink, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM c GROUP BY id, part),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part) AS component FROM k)
SELECT id, component::INT AS component, x1::INT AS x1, y1::INT AS y1, x2::INT AS x2, y2::INT AS y2, ink::INT AS ink, round_even(ink / ((x2 - x1) * (y2 - y1)), 4) AS density, round_even((x2 - x1) / (y2 - y1), 3) AS aspect FROM n WHERE ink >= 2""")
def micro_components(t):
    return I.per_mask(glyphs(t), lambda m: [(c["id"], c["x1"], c["y1"], c["x2"], c["y2"], c["ink"], c["density"], c["aspect"]) for c in I.micro_components(m)], "component int, x1 int, y1 int, x2 int, y2 int, ink int, density double, aspect double")


@query("a26_trace_features")
def trace_features(t):
    """Feature vectors in order of name, with the symbols of their paths."""
    row = lambda named, said: (list(named), list(named.values()), said)
    return I.per_mask(glyphs(t), lambda m: [row(I.features(m), I.symbols(m))], "feature_names array<string>, vector array<double>, symbols string")


@query("i8_row_projections", f"WITH {_INK} SELECT id, y, count(*) AS ink FROM g GROUP BY ALL")
def row_projections(t):
    out = I.per_mask(glyphs(t), lambda m: [(y, int(n)) for y, n in enumerate(I.projections(m)[0]) if n], "y int, ink int")
    return out.select("id", F.col("y").cast("bigint").alias("y"), F.col("ink").cast("bigint").alias("ink"))


@query("a25_quadrants", f"WITH {_INK}, c AS (SELECT id, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy FROM g GROUP BY id) SELECT id, count(*) FILTER (x <= cx AND y <= cy) AS top_left, count(*) FILTER (x > cx AND y <= cy) AS top_right, count(*) FILTER (x <= cx AND y > cy) AS bottom_left, count(*) FILTER (x > cx AND y > cy) AS bottom_right FROM g JOIN c USING (id) GROUP BY id")
def quadrants(t):
    """Ink around the centre of its box, left and top inclusive."""
    return I.per_mask(glyphs(t), lambda m: [tuple(I.quadrants(m).values())], "top_left bigint, top_right bigint, bottom_left bigint, bottom_right bigint")


@query("i6_vertical_groups")
def vertical_groups(t):
    """Vertical line fragments of each glyph by their middle column."""
    return I.per_mask(glyphs(t), lambda m: [(k, g["center_x"], g["fragments"], g["y1"], g["y2"], g["total_height"], g["structural"]) for k, g in enumerate(I.vertical_groups(I.vertical_lines(m), reach=2)[0])], "line int, center_x int, fragments int, y1 int, y2 int, total_height int, structural boolean")


# The recipes that the SQL of f18 and i15 names.
SQL_DAMAGES = ("cut_line", "blur", "black_noise", "erosion", "stamp")


@query("i14_damaged_samples")
def damaged_samples(t, recipes=I.DAMAGES):
    """Every glyph under every kind of damage, epochs and variants: identity and pixels changed."""

    epochs, variant, pixels = (0, 1), 0, 1 << 19

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for (h, w), alike in pdf.groupby(["height", "width"], sort=False):
                step = max(1, pixels // max(1, int(h) * int(w)) // len(epochs))
                for part in (alike.iloc[k : k + step] for k in range(0, len(alike), step)):
                    once = np.frombuffer(b"".join(part["data"]), np.uint8).reshape(len(part), h, w) > 0
                    masks, ids, epoch = np.concatenate([once] * len(epochs)), part["id"].tolist() * len(epochs), np.repeat(epochs, len(part))
                    for recipe in recipes:
                        samples, seeds = zip(*(I.seed_of(str(i), recipe, e, variant) for i, e in zip(ids, epoch.tolist(), strict=True)), strict=True)
                        changed = (augmentation.damaged_all(masks, recipe, seeds) ^ masks).sum(axis=(1, 2))
                        yield pd.DataFrame({"id": ids, "recipe": recipe, "epoch": epoch, "variant": variant, "sample": samples, "changed": changed})

    return glyphs(t).mapInPandas(run, "id long, recipe string, epoch int, variant int, sample string, changed int")


@query("f18_sample_identities", "SELECT p_partkey AS id, r AS recipe, e AS epoch, sha256(p_partkey || '|' || r || '|' || e || '|0') AS sample FROM part, unnest(['cut_line', 'blur', 'black_noise', 'erosion', 'stamp']) u(r), unnest([0, 1]) v(e)")
def sample_identities(t):
    return damaged_samples(t, SQL_DAMAGES).select("id", "recipe", "epoch", "sample")


_PIX = "q AS (SELECT event_id AS id, (event_id * 37 % 256)::BIGINT AS b, (user_id * 53 % 256)::BIGINT AS g, (value * 7)::BIGINT % 256 AS r FROM events), h AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS c FROM q), z AS (SELECT *, CASE WHEN v > 0 THEN round(255.0 * c / v) ELSE 0 END AS s FROM h)"


@query("i3_pixel_layers", f"WITH {_PIX} SELECT layer, count(*) AS pixels, sum(v)::BIGINT AS value FROM (SELECT *, CASE WHEN NOT (s >= 55 AND v >= 70 AND v <= 245 AND c >= 25) THEN CASE WHEN v <= 110 AND c < 40 THEN 'black' ELSE 'paper' END WHEN r >= b + 12 AND r >= g + 12 THEN 'red' WHEN b >= r + 12 AND b >= g + 12 THEN 'blue' WHEN g >= r + 12 AND g >= b + 12 THEN 'green' ELSE 'unknown' END AS layer FROM z) GROUP BY layer")
def pixel_layers(t):
    """Exclusive layers of pixels by saturation, value and the leading channel, as columns."""
    i = F.col
    q = t.events.select(i("event_id").alias("id"), (i("event_id") * 37 % 256).alias("b"), (i("user_id") * 53 % 256).alias("g"), (F.bround(i("value") * 7).cast("bigint") % 256).alias("r"))
    h = q.withColumns({"v": F.greatest("b", "g", "r"), "c": F.greatest("b", "g", "r") - F.least("b", "g", "r")}).withColumn("s", F.when(i("v") > 0, F.round(F.lit(255.0) * i("c") / i("v"))).otherwise(0))
    strong = (i("s") >= 55) & (i("v") >= 70) & (i("v") <= 245) & (i("c") >= 25)
    leads = lambda x, y, z: (i(x) >= i(y) + 12) & (i(x) >= i(z) + 12)
    layer = F.when(~strong & (i("v") <= 110) & (i("c") < 40), "black").when(~strong, "paper").when(leads("r", "b", "g"), "red").when(leads("b", "r", "g"), "blue").when(leads("g", "r", "b"), "green").otherwise("unknown")
    return h.groupBy(layer.alias("layer")).agg(F.count("*").alias("pixels"), F.sum("v").alias("value"))


@query("i4_bridge_pixels", f"""WITH {_INK}, f AS (SELECT DISTINCT p.id, p.y, p.x FROM p WHERE NOT EXISTS (FROM g WHERE g.id = p.id AND g.y = p.y AND g.x = p.x)), a(dy, dx) AS (VALUES (0, 1), (1, 0), (1, 1), (1, -1))
SELECT DISTINCT f.id, f.y::INT AS y, f.x::INT AS x FROM f, a, range(1, 3) m(d), range(1, 3) n(e) WHERE EXISTS (FROM g WHERE g.id = f.id AND g.y = f.y + a.dy * d AND g.x = f.x + a.dx * d) AND EXISTS (FROM g WHERE g.id = f.id AND g.y = f.y - a.dy * e AND g.x = f.x - a.dx * e)""")
def bridge_pixels(t):
    """Pixels lent to each glyph where ink stands on both sides of a gap within four pixels."""
    return I.per_mask(glyphs(t), lambda m: [(int(y), int(x)) for y, x in zip(*I.bridges(m, ~m, 2).nonzero(), strict=True)], "y int, x int")


@query("r18_trace_paths")
def trace_paths(t):
    """Paths of each skeleton after short ends have joined their continuations."""
    return I.per_mask(glyphs(t), lambda m: [(k, len(p["points"]), p["closed"], p["start"], p["end"], p["length"], len(p["merged"]), p["short"]) for k, p in enumerate(I.merged_spurs(I.Skeleton.of(I.thinned(m)).paths()))], "path int, points int, closed boolean, start string, stop string, length double, merged int, short boolean")


@query("r19_character_units")
def character_units(t):
    """Column ranges that blank columns split each glyph into."""
    return I.per_mask(glyphs(t), lambda m: [(k, a, b) for k, (a, b) in enumerate(I.character_parts(m))], "part int, start int, stop int")


@query("i17_image_differences", f"WITH {_INK} SELECT a.id, (SELECT count(*) FROM g WHERE g.id = a.id) AS ink, (SELECT count(*) FROM g WHERE g.id = a.id AND NOT (x = l AND y BETWEEN 3 AND 5)) AS kept FROM (SELECT DISTINCT id, l FROM p) a")
def image_differences(t):
    """Ink of each glyph, and what of it is left when part of its stem is wiped out."""

    def kernel(m):
        wiped = m.copy()
        columns = m.nonzero()[1]
        wiped[3:6, columns.min()] = False
        return [(int(m.sum()), int(wiped.sum()))]

    return I.per_mask(glyphs(t), kernel, "ink bigint, kept bigint")


@query("i15_manifest_regeneration", "SELECT count(*) AS samples, 0::BIGINT AS drifted FROM part, unnest(['cut_line', 'blur', 'black_noise', 'erosion', 'stamp']) u(r), unnest([0, 1]) v(e)")
def manifest_regeneration(t):
    """Samples made again from their coordinates: none may differ from the manifest."""
    keys = ["id", "recipe", "epoch", "variant"]
    first, again = damaged_samples(t, SQL_DAMAGES), damaged_samples(t, SQL_DAMAGES).withColumnsRenamed({"sample": "s", "changed": "c"})
    both = first.join(again, keys, "full_outer")
    return both.agg(F.count("*").alias("samples"), F.count_if(~(F.col("sample").eqNullSafe(F.col("s")) & F.col("changed").eqNullSafe(F.col("c")))).alias("drifted"))


@query("i1_step_pipeline", "SELECT p_partkey AS id, p_size AS before, p_size * 2 + 1 AS after FROM part WHERE p_size > 10")
def step_pipeline(t):
    """Named steps over a state run in order; an unknown name is an error."""
    from vellum.operators.steps import run_steps

    steps = {"keep_large": lambda df: df.filter("before > 10"), "double": lambda df: df.withColumn("after", F.col("before") * 2), "increment": lambda df: df.withColumn("after", F.col("after") + 1)}
    return run_steps(t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("before")), ["keep_large", "double", "increment"], steps)
