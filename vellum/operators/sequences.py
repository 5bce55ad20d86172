"""Ordered signals: extrema, smoothing, bands, peaks, run-length decoding, kernels.

Long form: a key, a place ``i`` and a value. Windows are by key; what depends on
earlier choices (spacing) is a fold over one key's candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def runs(rows: DataFrame, keys: list[str], order: str, what: Column, name: str = "run") -> DataFrame:
    """Numbers of maximal stretches in which ``what`` stays the same."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_w", what)
    marked = marked.withColumn("_new", (~F.col("_w").eqNullSafe(F.lag("_w").over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    return marked.withColumn(name, F.sum("_new").over(w)).drop("_w", "_new")


def decoded(steps: DataFrame, keys: list[str]) -> DataFrame:
    """CTC collapse of (step, token, confidence): repeats join, blanks (0) go.

    A run has its token, first and last step and mean confidence; index counts from 1."""
    r = runs(steps, keys, "step", F.col("token")).filter("token <> 0").groupBy(*keys, "run", "token").agg(F.min("step").alias("start"), F.max("step").alias("stop"), F.avg("confidence").alias("confidence"))
    return r.withColumn("index", F.row_number().over(Window.partitionBy(*keys).orderBy("run")))


def extrema(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Turning points of (i, y): flats are skipped; prominence is the smaller flank."""
    w = Window.partitionBy(*keys).orderBy("i")
    moved = rows.withColumn("d", F.signum(F.col("y") - F.lag("y").over(w))).filter("d <> 0")
    run = runs(moved, keys, "i", F.col("d")).groupBy(*keys, "run").agg(F.min_by("d", "i").alias("d"), F.min("i").alias("first"), F.max("i").alias("last"), F.max_by("y", "i").alias("end"))
    lead = Window.partitionBy(*keys).orderBy("run")
    start = rows.groupBy(*keys).agg(F.min_by("y", "i").alias("y0"))
    out = run.join(start, keys).withColumns({"begin": F.coalesce(F.lag("end").over(lead), F.col("y0")), "next": F.lead("end").over(lead)}).filter("next is not null")
    return out.select(*keys, F.col("last").alias("i"), F.col("end").alias("y"), F.when(F.col("d") > 0, "max").otherwise("min").alias("kind"), F.least(F.abs(F.col("end") - F.col("begin")), F.abs(F.col("end") - F.col("next"))).alias("prominence"))


_SPACED = T.ArrayType(T.StructType([T.StructField("i", T.LongType()), T.StructField("weight", T.DoubleType())]))


def spaced(candidates: Column, least: int, most: int | None = None) -> Column:
    """Greedy choice from structs (weight, i): the heaviest first, none nearer than ``least``
    to a chosen one; ties go to the lower place. Given back in order of place."""
    ordered = F.array_sort(F.transform(candidates, lambda c: F.struct((-c["weight"]).alias("w"), c["i"].cast("long").alias("i"))))

    def take(held, c):
        free = ~F.exists(held, lambda h: F.abs(h["i"] - c["i"]) < least)
        room = F.lit(True) if most is None else F.size(held) < most
        return F.when(free & room, F.concat(held, F.array(F.struct(c["i"].alias("i"), (-c["w"]).cast("double").alias("weight"))))).otherwise(held)

    return F.array_sort(F.aggregate(ordered, F.array().cast(_SPACED), take))


def smoothed(rows: DataFrame, keys: list[str], half: int = 2) -> DataFrame:
    """Centred moving sum over the window's width; beyond the ends there are zeros."""
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(-half, half)
    return rows.withColumn("smooth", F.sum("y").over(w) / (2 * half + 1))


def minima(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Local minima of (i, y); a flat one counts once, at its middle."""
    flat = runs(rows, keys, "i", F.col("y")).groupBy(*keys, "run").agg(F.first("y").alias("y"), F.min("i").alias("a"), F.max("i").alias("b"))
    w = Window.partitionBy(*keys).orderBy("run")
    both = flat.withColumns({"l": F.lag("y").over(w), "r": F.lead("y").over(w)}).filter("l > y and r > y")
    return both.select(*keys, F.floor((F.col("a") + F.col("b")) / 2).alias("i"), "y")


def bands(rows: DataFrame, keys: list[str], threshold: float, merge: int, least: int) -> DataFrame:
    """Stretches of places with y at or above a threshold; gaps up to ``merge`` close,
    stretches shorter than ``least`` go."""
    w = Window.partitionBy(*keys).orderBy("i")
    on = rows.filter(F.col("y") >= threshold).withColumn("gap", F.col("i") - F.lag("i").over(w) - 1)
    band = F.sum((F.coalesce("gap", F.lit(merge + 1)) > merge).cast("int")).over(w)
    return on.withColumn("band", band).groupBy(*keys, "band").agg(F.min("i").alias("start"), F.max("i").alias("stop")).filter(F.col("stop") - F.col("start") + 1 >= least)


def peaks(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Places not lower than their neighbours, at or above the threshold."""
    w = Window.partitionBy(*keys).orderBy("i")
    near = rows.withColumns({"l": F.coalesce(F.lag("y").over(w), F.lit(float("-inf"))), "r": F.coalesce(F.lead("y").over(w), F.lit(float("-inf")))})
    return near.filter((F.col("y") >= threshold) & (F.col("y") >= F.col("l")) & (F.col("y") >= F.col("r"))).drop("l", "r")


def heat(points: DataFrame, keys: list[str], bins: int = 64, radius: int = 2) -> DataFrame:
    """Triangular weight around each bin, the largest where several reach."""
    spread = points.select(*keys, "bin", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("o"))
    out = spread.select(*keys, (F.col("bin") + F.col("o")).alias("bin"), (1 - F.abs(F.col("o")) / (radius + 1)).alias("heat")).filter((F.col("bin") >= 0) & (F.col("bin") < bins))
    return out.groupBy(*keys, "bin").agg(F.max("heat").alias("heat"))


def directions(points: DataFrame, keys: list[str]) -> DataFrame:
    """Unit steps of a path (i, x, y): how often they change, turns left and right,
    entropy of the steps in bits, length and straightness."""
    w = Window.partitionBy(*keys).orderBy("i")
    step = points.withColumns({"dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w)}).filter("dx is not null")
    unit = step.withColumns({"sx": F.signum("dx").cast("int"), "sy": F.signum("dy").cast("int"), "length": F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double"))})
    turn = unit.withColumns({"px": F.lag("sx").over(w), "py": F.lag("sy").over(w)}).withColumn("cross", F.col("px") * F.col("sy") - F.col("py") * F.col("sx"))
    sums = turn.groupBy(*keys).agg(F.count_if((F.col("px") != F.col("sx")) | (F.col("py") != F.col("sy"))).alias("changes"), F.count_if(F.col("cross") > 0).alias("left"), F.count_if(F.col("cross") < 0).alias("right"), F.sum("length").alias("length"))
    share = unit.groupBy(*keys, "sx", "sy").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    bits = share.withColumn("p", p).groupBy(*keys).agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"))
    ends = points.groupBy(*keys).agg(F.min_by(F.struct("x", "y"), "i").alias("a"), F.max_by(F.struct("x", "y"), "i").alias("b"))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    straight = F.when(F.col("length") > 0, F.sqrt((dx * dx + dy * dy).cast("double")) / F.col("length")).otherwise(0.0)
    return sums.join(bits, keys).join(ends, keys).withColumn("straightness", straight).drop("a", "b")
