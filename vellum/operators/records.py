"""Projections between stages: aliases, payload choices, tokens, evidence records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def alias_of(doc: Column, *paths: str) -> Column:
    """The first path of a JSON text that is present and not empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(doc, p), F.lit("")) for p in paths])


def flattened(doc: Column, fields: dict[str, tuple[str, ...]]) -> list[Column]:
    """One column a feature from the first container that has it."""
    return [alias_of(doc, *paths).alias(name) for name, paths in fields.items()]


def tokenized(word: Column, tokens: list[str]) -> Column:
    """Greedy longest match left to right; null if a part matches nothing."""
    ordered = sorted(tokens, key=lambda t: (-len(t), t))
    pattern = "|".join("".join(c if c.isalnum() else f"\\{c}" for c in t) for t in ordered)
    found = F.regexp_extract_all(word, F.lit(f"({pattern})"), F.lit(1))
    whole = F.aggregate(found, F.lit(0), lambda n, t: n + F.length(t)) == F.length(word)
    return F.when(whole, found)


def word_trust(confidence: Column, expected: Column, found: Column) -> Column:
    """Weight of a word-level reading: 0.35 where its length disagrees, 0.75 where it is unsure."""
    return F.when(expected != found, 0.35).otherwise(1.0) * F.when(confidence < 0.5, 0.75).otherwise(1.0)


def topology_gain(before: dict[str, Column], after: dict[str, Column], weights: dict[str, tuple[float, float]]) -> Column:
    """Weighted falls of counts, each within its cap."""
    out = F.lit(0.0)
    for name, (weight, cap) in weights.items():
        fall = F.greatest(F.lit(-cap), F.least(F.lit(cap), (before[name] - after[name]).cast("double")))
        out = out + fall * weight
    return out


def grid_score(grid: Column) -> tuple[Column, Column]:
    """Crop quality 0 to 100 from a grid of densities, and what speaks against it."""
    n = F.greatest(F.lit(1), F.size(grid))
    empty = F.size(F.filter(grid, lambda d: d < 0.01)) / n
    full = F.size(F.filter(grid, lambda d: d > 0.8)) / n
    mean = F.aggregate(grid, F.lit(0.0), lambda a, d: a + d) / n
    faults = F.array_compact(F.array(F.when(empty > 0.6, "mostly_empty"), F.when(full > 0.3, "overfilled"), F.when(mean < 0.02, "too_faint")))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 60 * empty - 80 * full)), faults


def direction_shares(counts: dict[str, Column]) -> dict[str, Column]:
    """Counts of directions over their sum; all 0 without any."""
    total = None
    for c in counts.values():
        total = c if total is None else total + c
    return {k: F.when(total > 0, c / total).otherwise(0.0) for k, c in counts.items()}


def one_hot_bins(positions: Column, width: Column, bins: int) -> Column:
    """0/1 per bin: positions on a width go to the nearest bin (half to even), the last inclusive."""
    at = F.transform(positions, lambda p: F.least(F.lit(bins - 1), F.bround(p / F.greatest(F.lit(1.0), width) * (bins - 1)).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.array_contains(at, b).cast("int"))


def padded_tokens(tokens: Column, length: int) -> Column:
    """Cut or filled with zeros to a length."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(0), length)), 1, length)


def split_wide(segments: DataFrame, keys: list[str], limit: float, most: int = 2) -> DataFrame:
    """Segments wider than ``limit`` times the mean halved at the middle, at most ``most`` a
    unit, in order of place; others as they are."""
    of = Window.partitionBy(*keys)
    wide = F.col("stop") - F.col("start") > limit * F.avg(F.col("stop") - F.col("start")).over(of)
    nth = F.sum(F.col("wide").cast("int")).over(of.orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0))
    rows = segments.withColumn("wide", wide).withColumn("cut", F.col("wide") & (nth <= most))
    middle = F.floor((F.col("start") + F.col("stop")) / 2)
    part = lambda a, b: F.struct(a.alias("start"), b.alias("stop"))
    pieces = F.when(F.col("cut"), F.array(part(F.col("start"), middle), part(middle, F.col("stop")))).otherwise(F.array(part(F.col("start"), F.col("stop"))))
    return rows.select(*keys, F.explode(pieces).alias("p"), "cut").select(*keys, "p.start", "p.stop", "cut")


def snapped(cuts: DataFrame, ink: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Each cut moved to the bin of least ink within the radius (nearest, then lowest)."""
    spread = cuts.select(*keys, F.col("bin").alias("cut"), F.explode(F.sequence(F.col("bin") - radius, F.col("bin") + radius)).alias("bin"))
    near = spread.join(ink, [*keys, "bin"])
    return near.groupBy(*keys, "cut").agg(F.min_by("bin", F.struct("ink", F.abs(F.col("bin") - F.col("cut")).alias("far"), "bin")).alias("bin"))


def selected_path(paths: DataFrame, keys: list[str]) -> DataFrame:
    """The first path whose status says selected, else the first of all."""
    chosen = F.col("status").isin("selected", "selected_for_v0_2_segment_artifacts", "selected_for_assembly")
    return paths.groupBy(*keys).agg(F.min_by(F.struct("path", "status"), F.struct((~chosen).cast("int").alias("a"), F.col("seq").alias("b"))).alias("p")).select(*keys, "p.path", "p.status")


# Settings of the crop refiner.
REFINER = {
    "input_mode": "scribemap_2_layers",
    "layers_to_refine": "blue,red,green,unknown_color,black",
    "crop_padding_px": 2,
    "debug_preview_enabled": True,
    "correction_routing_enabled": True,
    "correction_min_crossing_ink_pixels": 6,
    "correction_min_horizontal_span_ratio": 0.35,
    "correction_min_vertical_span_ratio": 0.45,
    "correction_replacement_max_distance_px": 55,
    "correction_replacement_min_width_px": 8,
    "correction_replacement_min_height_px": 8,
    "correction_replacement_min_area": 80,
    "correction_replacement_max_aspect_ratio": 12.0,
    "correction_max_replacements_per_blue": 2,
    "stacked_text_split_enabled": True,
    "stacked_text_split_layers": "blue,green,black,unknown_color",
    "stacked_text_min_height_px": 68,
    "stacked_text_min_width_px": 70,
    "stacked_text_min_aspect_ratio": 1.35,
    "stacked_text_row_ink_ratio": 0.012,
    "stacked_text_min_gap_px": 4,
    "stacked_text_merge_gap_px": 3,
    "stacked_text_projection_valley_enabled": True,
    "stacked_text_projection_valley_max_ratio": 0.45,
    "stacked_text_projection_min_side_ink_ratio": 0.22,
    "stacked_text_min_segment_height_px": 12,
    "stacked_text_segment_padding_px": 2,
    "stacked_text_max_segments": 4,
}
# Older names of settings.
REFINER_ALIASES = {"input_mode": "input_group_mode", "layers_to_refine": "scribemap_2_layers_to_refine"}

# Masks that a layer's crop keeps, for analysis, for its mask and with context.
CROP_MASKS = {
    "blue": (["blue"], ["blue_continuity"], ["blue", "black"]),
    "green": (["green"], ["green"], ["green", "black"]),
    "black": (["black"], ["black"], ["black"]),
    "red": (["red"], ["red_continuity"], ["red", "blue", "black"]),
    "unknown_color": (["unknown_color"], ["unknown_color"], ["unknown_color", "blue", "black"]),
}

# Weight of each tier of evidence.
TIERS = {"high": 1.0, "medium": 0.55, "low": 0.2}


def overlaid(given: Column, defaults: dict, aliases: dict[str, str] | None = None) -> dict[str, Column]:
    """A column a setting: what a map<string, string> gives under its name, or under its older
    one, else the default. Unknown names are ignored; a value that can't be read is the default."""
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    out = {}
    for name, value in defaults.items():
        said = F.coalesce(*[F.try_element_at(given, F.lit(n)) for n in (name, (aliases or {}).get(name)) if n])
        kind = kinds[type(value)]
        out[name] = F.coalesce(said if kind == "string" else said.try_cast(kind), F.lit(value))
    return out


def is_replacement(width: Column, height: Column, area: Column, settings: dict = REFINER) -> Column:
    """Whether a red group is large enough, and not too thin, to hold corrected text."""
    least = {k: settings[f"correction_replacement_min_{k}"] for k in ("width_px", "height_px", "area")}
    aspect = F.greatest(width / height.cast("double"), height / width.cast("double"))
    return (width >= least["width_px"]) & (height >= least["height_px"]) & (area >= least["area"]) & (aspect <= settings["correction_replacement_max_aspect_ratio"])


def crop_masks(layer: Column) -> dict[str, Column]:
    """Names of masks that a layer's crop keeps; an unknown layer keeps its own."""
    out = {}
    for k, use in enumerate(("analysis", "analysis_mask", "context")):
        made = F.array(layer)
        for name, kept in CROP_MASKS.items():
            made = F.when(layer == name, F.array(*map(F.lit, kept[k]))).otherwise(made)
        out[use] = made
    return out


def first_object(doc: Column, *paths: str) -> Column:
    """The first path of a JSON text that holds an object with something in it."""
    found = [F.get_json_object(doc, p) for p in paths]
    return F.coalesce(*[F.when(x.startswith("{") & (x != "{}"), x) for x in found])


def observed_payload(doc: Column) -> Column:
    """What was observed: named payloads by priority, then nested ones, else the record itself."""
    names = ("traced", "auto", "observed", "scrilog_auto", "auto_detected", "signature", "scrilog_observation", "selected_scrilog_observation")
    nested = ("$.reconstruction.selected_scrilog_observation", "$.metrics.scrilog_observation")
    return F.coalesce(first_object(doc, *[f"$.{n}" for n in names], *nested), doc)


def expected_payload(doc: Column) -> Column:
    """What a person verified, by priority; null without any."""
    return first_object(doc, *[f"$.{n}" for n in ("expected", "human_verified", "manual", "ground_truth", "verified", "truth", "expected_signature")])


def geometry_payload(doc: Column) -> Column:
    """Measured geometry of a record, else of its metadata; null where it must be measured."""
    names = ("geometry", "image_geometry", "physical_geometry", "crop_geometry", "bbox_geometry")
    return first_object(doc, *[f"$.{n}" for n in names], *[f"$.metadata.{n}" for n in names])


def executed(jobs: DataFrame, segments: DataFrame, expert: str) -> DataFrame:
    """Queued jobs (unit, path, segment, experts) with the result that the expert gave for
    their selected segment; null where it wasn't asked, or gave none."""
    own = segments.filter("selected").select("unit", "path", "segment", F.col("result").alias("found")).dropDuplicates(["unit", "path", "segment"])
    asked = F.array_contains("experts", expert)
    return jobs.join(own, ["unit", "path", "segment"], "left").withColumn("executed", F.when(asked, F.col("found"))).drop("found")


def vector(features: Column, names: list[str]) -> Column:
    """A map<string, string> as numbers in the order of names; what lacks, or is no number, is 0."""
    return F.array(*[F.coalesce(F.nanvl(F.try_element_at(features, F.lit(n)).try_cast("double"), F.lit(0.0)), F.lit(0.0)) for n in names])


def refiner_payload(status: Column, score: Column, faults: Column, next_node: Column) -> Column:
    """Final status of a crop with its reason: the faults found, or that it is fine."""
    reason = F.when(F.size(faults) > 0, F.array_join(faults, ",")).otherwise("quality_ok")
    return F.struct(status.alias("status"), reason.alias("status_reason"), next_node.alias("next_node"), score.alias("final_score"))


def refinement_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts of final statuses (others than accepted and rejected are for review; one that
    lacks too) and next nodes of each document."""
    status, node = F.coalesce("status", F.lit("review")), F.coalesce("next_node", F.lit("visual_classification"))
    counts = {"accepted": status == "accepted", "review": ~status.isin("accepted", "rejected"), "rejected": status == "rejected", "visual_classification": node == "visual_classification", "none": node == "none"}
    return rows.groupBy(*keys).agg(*[F.count_if(c).alias(f"{n}_count") for n, c in counts.items()])


def evidence_policy(fields: DataFrame) -> DataFrame:
    """Fields (name, importance, observed_path) as a policy: importance (low unless said), its
    weight, and where the observation is (under the field's name unless said)."""
    tier = F.when(F.col("importance").isin(*TIERS), F.col("importance")).otherwise("low")
    weight = F.lit(TIERS["low"])
    for name, value in TIERS.items():
        weight = F.when(tier == name, F.lit(value)).otherwise(weight)
    return fields.select("name", tier.alias("importance"), weight.alias("weight"), F.coalesce("observed_path", "name").alias("observed_path"))


def case_metrics(cases: DataFrame) -> DataFrame:
    """Cases (label, source, started, ended, names, vector) with elapsed seconds, number of
    features, and a hash of names and values to compare runs by."""
    said = F.zip_with("names", "vector", lambda n, v: F.concat(n, F.lit("="), F.format_string("%.6f", v)))
    elapsed = F.unix_micros("ended") - F.unix_micros("started")
    return cases.select("label", "source", (elapsed / 1e6).alias("elapsed_seconds"), F.size("names").cast("bigint").alias("feature_count"), F.sha2(F.array_join(said, "|"), 256).alias("vector_hash"))


def active_features(traces: DataFrame) -> DataFrame:
    """Traces (names, vector, source, selected_names, selected_vector) with the features in
    use: the reconstruction's where it was selected, else the original's. A selected vector
    that lacks, is misaligned or has other names than the original is an error."""
    chosen = F.col("source") == "reconstructed"
    bad = chosen & (F.col("selected_names").isNull() | (F.size("selected_names") == 0) | (F.size("selected_names") != F.coalesce(F.size("selected_vector"), F.lit(-1))) | ((F.size("names") > 0) & (F.col("names") != F.col("selected_names"))))
    vector_ = F.when(bad, F.raise_error(F.lit("the reconstruction's features don't fit")).cast("array<double>")).when(chosen, F.col("selected_vector")).otherwise(F.col("vector"))
    return traces.withColumns({"active_source": F.when(chosen, "reconstructed").otherwise("original"), "active_vector": vector_})


def word_cuts(heads: DataFrame, threshold: float = 0.35, min_distance: int = 2) -> DataFrame:
    """Expected length, its confidence and cut bins of units from a sequence model's heads
    (unit, boundary, bridge, safety: array<double> a bin; length: array<double> a class).

    A bin's score is its boundary, less its bridge, times its safety. Bins of at least the
    threshold are taken, the best first (the lower of equal ones), each ``min_distance`` from
    those before, as many as the expected length has splits; then they stand in order."""
    scores = F.zip_with(F.zip_with("boundary", "bridge", lambda a, b: F.greatest(F.lit(0.0), a - b)), "safety", lambda a, s: a * s)
    best = F.array_max("length")
    bins = F.filter(F.transform(F.col("score"), lambda s, i: F.struct((-s).alias("s"), i.alias("bin"))), lambda x: -x["s"] >= threshold)
    far = lambda taken, b: F.forall(taken, lambda t: F.abs(t - b) >= min_distance)
    none = F.array().cast("array<int>")
    picked = F.aggregate(F.array_sort(bins), none, lambda taken, x: F.when((F.size(taken) < F.col("splits")) & far(taken, x["bin"]), F.concat(taken, F.array(x["bin"]))).otherwise(taken))
    rows = heads.select("unit", scores.alias("score"), (F.array_position("length", best) - 1).alias("expected"), best.alias("confidence"))
    rows = rows.withColumn("splits", F.greatest(F.lit(0), F.col("expected") - 1))
    return rows.select("unit", "expected", "confidence", F.array_sort(picked).alias("cuts"))
