"""Keyed, positional, spatial, interval, difference and existence joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import columns as C

#: Side of the grid cells that bound which boxes can be near each other.
CELL = 64


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in ``order``, as when a dictionary is filled in turn."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_k = 1").drop("_k")


def first_of(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def left_last(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Left join with the last duplicate of the right side."""
    return left.join(last_of(right, keys, order), keys, "left")


def cells(rows: DataFrame, box: str, reach: int = 0) -> DataFrame:
    """A row per grid cell that a box, grown by ``reach``, touches."""
    b = F.col(box)
    lo = lambda c: F.floor((c - reach) / CELL)
    hi = lambda c: F.floor((c + reach) / CELL)
    return rows.withColumn("cx", F.explode(F.sequence(lo(b["x1"]), hi(b["x2"])))).withColumn("cy", F.explode(F.sequence(lo(b["y1"]), hi(b["y2"]))))


def near(left: DataFrame, right: DataFrame, keys: list[str], reach: int = 0) -> DataFrame:
    """Pairs of boxes ``a`` and ``b`` of a key at most ``reach`` apart, each once.

    Boxes meet in grid cells, an equi-join, instead of all with all; the pair is
    kept in the first cell that both touch. ``left`` has id_a and a, ``right`` id_b and b."""
    one, two = cells(left, "a", reach), cells(right, "b")
    a, b = F.col("a"), F.col("b")
    own = (F.col("cx") == F.greatest(F.floor((a["x1"] - reach) / CELL), F.floor(b["x1"] / CELL))) & (F.col("cy") == F.greatest(F.floor((a["y1"] - reach) / CELL), F.floor(b["y1"] / CELL)))
    return one.join(two, [*keys, "cx", "cy"]).filter(own).drop("cx", "cy").withColumn("distance", C.distance(a, b)).filter(F.col("distance") <= reach)


def corrections(blues: DataFrame, reds: DataFrame, reach: int = 55, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Blue boxes that a red one crosses, and the nearest other reds that replace them.

    Crossing: (doc, id_a, crossings). Replacements rank by distance, larger area, id."""
    crossing = near(blues, reds, ["doc"]).filter(C.overlap(F.col("a"), F.col("b")) > 0)
    deleted = crossing.groupBy("doc", "id_a").agg(F.count("*").alias("crossings"))
    strokes = crossing.select("doc", "id_b").distinct()
    other = reds.join(strokes, ["doc", "id_b"], "left_anti")
    found = near(blues.join(deleted, ["doc", "id_a"], "left_semi"), other, ["doc"], reach)
    order = Window.partitionBy("doc", "id_a").orderBy(F.round("distance", 4), F.desc(C.area(F.col("b"))), "id_b")
    return deleted, found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def best_overlaps(left: DataFrame, right: DataFrame, keys: list[str], least: float = 0.25) -> DataFrame:
    """For each left box the right one with the largest share of the smaller area."""
    share = C.overlap(F.col("a"), F.col("b")) / F.greatest(F.lit(1), F.least(C.area(F.col("a")), C.area(F.col("b"))))
    pairs = near(left, right, keys).withColumn("share", share).filter(F.col("share") >= least)
    return pairs.groupBy(*keys, "id_a").agg(F.max_by(F.struct("id_b", "share"), F.struct("share", -F.col("id_b"))).alias("best")).select(*keys, "id_a", "best.id_b", "best.share")


def aligned(boundaries: DataFrame, hints: DataFrame, tolerance: int = 1) -> DataFrame:
    """The most probable hint within ``tolerance`` bins of each boundary.

    A hint is copied to the bins it reaches, so the join is by equality."""
    spread = hints.withColumn("bin", F.explode(F.sequence(F.col("hint") - tolerance, F.col("hint") + tolerance)))
    best = spread.groupBy("unit", "bin").agg(F.max_by(F.struct("probability", "hint"), F.struct("probability", -F.col("hint"))).alias("best"))
    return boundaries.join(best, ["unit", "bin"], "left").select(*boundaries.columns, "best.probability", "best.hint")


def tree_difference(before: DataFrame, after: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Status of every key of two trees: added, removed, changed or unchanged."""
    a, b = before.select(*keys, F.col(digest).alias("old")), after.select(*keys, F.col(digest).alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return a.join(b, keys, "full_outer").withColumn("status", status)


def baseline_difference(before: DataFrame, now: DataFrame, key: str, fields: list[str], seconds: str, slower: float = 1.5) -> DataFrame:
    """Fields that differ from a baseline (nulls equal), and a warning beyond ``slower`` times its time."""
    old = before.select(key, *[F.col(f).alias(f"old_{f}") for f in [*fields, seconds]])
    differ = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"old_{f}")), f) for f in fields]))
    return now.join(old, key, "left").withColumns({"differences": differ, "slow": F.coalesce(F.col(seconds) > slower * F.col(f"old_{seconds}"), F.lit(False)), "known": F.col(f"old_{seconds}").isNotNull()})


def flags(ids: DataFrame, stages: dict[str, DataFrame], key: str) -> DataFrame:
    """Every id of the source or of any stage, whether each stage has it, and how many do."""
    every = ids.select(key, F.lit("source").alias("stage"))
    for name, rows in stages.items():
        every = every.unionByName(rows.select(key, F.lit(name).alias("stage")))
    out = every.groupBy(key).agg(*[F.max(F.col("stage") == s).alias(f"has_{s}") for s in ("source", *stages)])
    return out.withColumn("stages", reduce_sum([F.col(f"has_{s}").cast("int") for s in stages]))


def reduce_sum(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def json_leaves(doc: str):
    """Rows (path, kind, value) of all scalars and empty containers of a JSON text."""
    import json

    def walk(node, path):
        if isinstance(node, dict) and node:
            for k, v in node.items():
                yield from walk(v, f"{path}.{k}")
        elif isinstance(node, list) and node:
            for k, v in enumerate(node):
                yield from walk(v, f"{path}[{k}]")
        else:
            kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}[type(node)]
            yield path, kind, json.dumps(node, ensure_ascii=False)

    try:
        return list(walk(json.loads(doc), "$")) if doc is not None else []
    except ValueError:
        return [("$", "invalid", doc)]


def json_difference(pairs: DataFrame, recorded: int = 300) -> DataFrame:
    """Structural differences of (id, before, after): path and status, and the full count.

    At most ``recorded`` of an id are listed, in order of path; all are counted."""
    import pandas as pd

    def leaves(batches):
        for pdf in batches:
            rows = [(i, side, *leaf) for i, b, a in pdf.itertuples(index=False) for side, doc in (("b", b), ("a", a)) for leaf in json_leaves(doc)]
            yield pd.DataFrame(rows, columns=["id", "side", "path", "kind", "value"])

    rows = pairs.select("id", "before", "after").mapInPandas(leaves, f"id {pairs.schema['id'].dataType.simpleString()}, side string, path string, kind string, value string")
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    both = rows.groupBy("id", "path").agg(side("b", "kind").alias("old_kind"), side("b", "value").alias("old"), side("a", "kind").alias("new_kind"), side("a", "value").alias("new"))
    status = F.when(F.col("old_kind").isNull(), "added").when(F.col("new_kind").isNull(), "removed").when(F.col("old_kind") != F.col("new_kind"), "type_changed").when(F.col("old") != F.col("new"), "changed")
    differ = both.withColumn("status", status).filter("status is not null")
    return differ.withColumns({"total": F.count("*").over(Window.partitionBy("id")), "nth": F.row_number().over(Window.partitionBy("id").orderBy("path"))}).filter(F.col("nth") <= recorded)
