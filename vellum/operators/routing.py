"""Routing of crops: classes from scores, routes, policies, reasons, statuses, damage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Thresholds of the visual classes.
THRESHOLDS = {"printed": 0.45, "handwriting": 0.45, "noise": 0.65, "mixed_safety": 0.25}

# Routes of each visual class.
ROUTES = {"mixed": ["printed_ocr", "handwritten_ocr"], "printed_only": ["printed_ocr"], "handwriting_only": ["handwritten_ocr"], "empty_or_noise": ["archive"], "review": ["review"]}

# Fixed values: (layer, hypothesis, role, next node, needs a visual class, mode, text candidate, kept as evidence).
POLICIES = [
    ("blue", "probable_handwriting", "probable_handwriting", "N05_handwritten_ocr", True, "handwriting_audit", True, False),
    ("green", "probable_handwriting", "probable_handwriting", "N05_handwritten_ocr", True, "handwriting_audit", True, False),
    ("red", "probable_markup_or_correction", "correction_markup", "N06_correction_resolver", False, "skip_markup_evidence", False, True),
    ("black", "dark_ink_unknown_role", "dark_ink_needs_visual_routing", "N03_visual_classification_router", True, "primary_router", True, False),
    ("unknown_color", "ambiguous_colored_ink", "unknown_colored_ink", "N03_visual_classification_router", True, "fallback_router", True, False),
]
POLICY = "layer string, hypothesis string, role string, next_node string, required boolean, mode string, candidate boolean, evidence boolean"

# Repairs that each kind of damage allows.
REPAIRS = {
    "clean": [],
    "light_cut": ["horizontal_gap_closing", "vertical_gap_closing", "endpoint_bridge"],
    "light_blur": ["threshold_normalization"],
    "scanner_noise": ["component_denoising", "median_denoising"],
    "light_erosion": ["conservative_stroke_recovery", "endpoint_bridge", "horizontal_gap_closing", "vertical_gap_closing"],
    "ink_overlap": ["linear_artifact_removal", "contamination_opening", "endpoint_bridge"],
    "stamp_interference": ["stamp_external_artifact_removal", "contamination_opening"],
    "bleed_through": ["threshold_normalization", "component_denoising", "median_denoising"],
    "edge_crop_loss": ["border_continuation"],
    "threshold_failure": ["threshold_normalization", "horizontal_gap_closing", "vertical_gap_closing", "endpoint_bridge"],
}

# Expert weights (trace, glyph, shape, context) under each kind of damage; others weigh as clean.
EXPERTS = {
    "clean": (1.0, 1.0, 0.7, 0.5),
    "light_cut": (0.85, 0.95, 0.7, 0.5),
    "light_erosion": (0.85, 0.95, 0.7, 0.5),
    "light_blur": (0.9, 0.75, 0.7, 0.5),
    "compression_artifacts": (0.9, 0.75, 0.7, 0.5),
    "scanner_noise": (0.8, 0.9, 0.7, 0.5),
    "bleed_through": (0.8, 0.9, 0.7, 0.5),
    "ink_overlap": (0.65, 0.65, 0.7, 0.85),
    "stamp_interference": (0.65, 0.65, 0.7, 0.85),
    "edge_crop_loss": (0.7, 0.7, 0.7, 0.9),
}
# Reason codes of groups that aren't classified.
NOT_REQUIRED, REJECTED, NO_INPUT = "minos_not_required_by_n02_policy", "rejected_by_refiner", "no_valid_minos_input_crop"

RISKY = ("ink_overlap", "stamp_interference")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def visual_class(printed: Column, handwriting: Column, noise: Column, thresholds: dict | None = None, safety: bool = True) -> Column:
    """First that holds: noise alone, both, printed with weak handwriting (if ``safety``),
    printed, handwriting, review. Thresholds may be columns."""
    t = {k: _col(v) for k, v in (THRESHOLDS | (thresholds or {})).items()}
    p, h, n = printed >= t["printed"], handwriting >= t["handwriting"], noise >= t["noise"]
    out = F.when(n & ~p & ~h, "empty_or_noise").when(p & h, "mixed")
    if safety:
        out = out.when(p & (handwriting >= t["mixed_safety"]), "mixed")
    return out.when(p, "printed_only").when(h, "handwriting_only").otherwise("review")


def route(visual: Column) -> Column:
    out = F.array(F.lit("review"))
    for name, steps in ROUTES.items():
        out = F.when(visual == name, F.array(*map(F.lit, steps))).otherwise(out)
    return out


def to_printed(visual: Column) -> Column:
    return visual.isin("printed_only", "mixed")


def to_handwriting(visual: Column, layer: Column, forced: Column, layers=("blue", "green", "black", "unknown_color")) -> Column:
    return (forced | visual.isin("handwriting_only", "mixed")) & F.lower(layer).isin(*layers)


def layer_of(layer: Column, mask: Column) -> Column:
    """The layer itself, else a mask's name without its suffix."""
    return F.coalesce(F.nullif(layer, F.lit("")), F.regexp_replace(mask, "_(ink_layer|continuity_mask|ink_mask)$", ""))


def skip_reason(required: Column, status: Column, path: Column, include_rejected: bool = False) -> Column:
    """Why a group isn't classified; null if it is."""
    out = F.when(required == F.lit(False), NOT_REQUIRED)
    if not include_rejected:
        out = out.when(status == "rejected", REJECTED)
    return out.when(path.isNull(), NO_INPUT)


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, POLICY)


def with_policy(rows: DataFrame) -> DataFrame:
    """Adds a layer's policy; an unknown layer goes to review."""
    out = rows.join(F.broadcast(policies(rows.sparkSession)), "layer", "left")
    default = {"hypothesis": "unknown_layer", "role": "review", "next_node": "review", "required": True, "mode": "fallback_router", "candidate": True, "evidence": False}
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in default.items()})


def reject_reason(width: Column, height: Column, density: Column, components: Column) -> Column:
    """Why a group is structure or dirt and not text; null if it is kept."""
    area, wide, tall = width * height, width / F.greatest(height, F.lit(1)), height / F.greatest(width, F.lit(1))
    out = F.when((width > 350) | (height > 122) | (area > 34000), "oversized_group")
    out = out.when((width >= 18) & (height <= 10) & (wide >= 5), "horizontal_line_like_group")
    out = out.when((height >= 18) & (width <= 10) & (tall >= 4), "vertical_line_like_group")
    out = out.when((area <= 60) & (width <= 10) & (height <= 10), "tiny_isolated_group")
    out = out.when((area <= 200) & (density >= 0.80), "small_dense_blob")
    out = out.when((width <= 18) & (height <= 18) & (area <= 260) & (density >= 0.5) & wide.between(0.7, 1.45) & (components <= 2), "small_dense_square_blob")
    return out.when(width.between(24, 40) & height.between(20, 36) & (area <= 1300) & density.between(0.08, 0.25) & wide.between(0.8, 1.5) & (components <= 3), "small_hollow_square_blob")


def condition(components: Column, endpoints: Column, isolated: Column, short_paths: Column) -> Column:
    """struct(condition, damage, confidence, severity, notes) from topology counts."""
    notes = F.array_compact(F.array(F.when(components > 1, "multiple_components"), F.when(endpoints >= 4, "many_endpoints"), F.when(isolated > 0, "isolated_points"), F.when(short_paths > 0, "short_paths")))
    bad = F.size(notes) > 0
    return F.struct(F.when(bad, "uncertain").otherwise("clean").alias("condition"), F.when(bad, "unknown").otherwise("clean").alias("damage"), F.when(bad, 0.35).otherwise(0.8).alias("confidence"), F.least(F.lit(1.0), F.lit(0.15) * F.size(notes)).alias("severity"), F.when(bad, notes).otherwise(F.array(F.lit("no_strong_damage_signal"))).alias("notes"))


def with_repairs(rows: DataFrame) -> DataFrame:
    """Adds allowed repairs, expert weights and whether a person must look, by damage."""
    table = [(k, REPAIRS.get(k, []), *EXPERTS.get(k, EXPERTS["clean"])) for k in sorted({*REPAIRS, *EXPERTS})]
    known = rows.sparkSession.createDataFrame(table, "damage string, repairs array<string>, trace double, glyph double, shape double, context double")
    out = rows.join(F.broadcast(known), "damage", "left").withColumn("repairs", F.coalesce("repairs", F.array().cast("array<string>")))
    out = out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in zip(("trace", "glyph", "shape", "context"), EXPERTS["clean"], strict=True)})
    low = (F.col("confidence") < 0.45) & (F.col("damage") != "clean")
    reason = F.concat(F.when(low, "low_confidence_").otherwise(""), F.lit("route_for_"), "damage")
    return out.withColumns({"manual_review": F.col("damage").isin(*RISKY) | (F.col("condition") == "uncertain") | low, "reason": reason})


def decision_status(text: Column, score: Column, populated: Column, positions: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", "empty").when(populated / F.greatest(F.lit(1), positions) < 0.7, "weak_low_coverage").when(score < 0.42, "weak_low_score").otherwise("provisional_ready")
