"""Structural rules over glyph signatures: facts, families, warnings and class effects.

A rule has a condition on a signature's columns, facts that must be there already
(optional) and the facts it states. Rules run in order, pass after pass, until a
pass adds no fact; facts of earlier rules count for later ones of the same pass. It
all happens within a signature's row, so nothing shuffles. Facts are written
predicate:argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Default rules as (name, condition on the signature, facts stated).
RULES = [
    ("family_looped", "loops >= 1", ["family:looped", "has_structure:loop"]),
    ("family_no_loop", "loops = 0", ["family:no_loop"]),
    ("family_multi_loop", "loops >= 2", ["family:multi_loop", "warning:multi_loop_complexity"]),
    ("family_zero_endpoint", "endpoints = 0", ["family:closed_or_no_endpoint", "warning:zero_endpoints_check_skeleton"]),
    ("family_single_endpoint", "endpoints = 1", ["family:single_endpoint", "warning:single_endpoint_unusual"]),
    ("family_two_endpoint", "endpoints = 2", ["family:two_endpoint", "has_structure:normal_path_exit_count"]),
    ("family_many_endpoint", "endpoints >= 5", ["family:many_endpoint", "warning:possible_fragmentation_or_noise"]),
    ("family_unbranched", "junctions = 0", ["family:unbranched"]),
    ("family_branched", "junctions >= 1", ["family:branched", "has_structure:junction"]),
    ("warning_overbranched", "junctions >= 4", ["warning:overbranched_check_artifact_or_bad_reconstruction"]),
    ("family_top_contact", "top_contact", ["family:top_contact"]),
    ("family_bottom_contact", "bottom_contact", ["family:bottom_contact"]),
    ("family_wide", "aspect >= 1.35", ["family:wide"]),
    ("family_tall", "aspect > 0 AND aspect <= 0.75", ["family:tall"]),
    ("family_compact", "aspect > 0.75 AND aspect < 1.35", ["family:compact"]),
    ("family_horizontal_dominant", "horizontal >= 0.45", ["family:horizontal_dominant"]),
    ("family_vertical_dominant", "vertical >= 0.45", ["family:vertical_dominant"]),
    ("family_diagonal_rich", "diagonal >= 0.35", ["family:diagonal_rich"]),
    ("family_curve_rich", "curve >= 0.35", ["family:curve_rich"]),
    ("history_reconstructed", "phase > 0", ["history:reconstructed"]),
    ("history_line_removal", "line_removed", ["history:line_removal_applied"]),
    ("warning_unfinished_bridge", "bridge_required AND NOT bridge_completed", ["warning:bridge_required_but_not_completed", "selection_risk:unsafe_reconstruction_candidate"]),
    ("history_completed_bridge", "bridge_required AND bridge_completed", ["history:bridge_repair_completed"]),
    ("combined_complex_loop_branch_endpoint", "loops >= 1 AND junctions >= 1 AND endpoints >= 3", ["family:complex_loop_branch_endpoint"]),
]
MOST_PASSES = 4
_STATE = "struct<known:array<string>,said:array<string>,fires:int,passes:int,done:boolean>"


def _state(known, said, fires, passes, done) -> Column:
    return F.struct(known.alias("known"), said.alias("said"), fires.alias("fires"), passes.alias("passes"), done.alias("done")).cast(_STATE)


def chained(signatures: DataFrame, rules=RULES, most_passes: int = MOST_PASSES, given: Column | None = None) -> DataFrame:
    """id and the end state of forward chaining: known (facts), said (fact, tab, rule name),
    fires (rules whose condition held, in each pass), passes. ``given``: facts to begin with."""
    holds = []
    for name, condition, states, *needs in rules:
        rule = F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, states)).alias("states"), F.array(*map(F.lit, needs[0] if needs else [])).cast("array<string>").alias("needs"))
        holds.append(F.when(F.expr(condition), rule))
    if given is None and most_passes > 1 and not any(r[3:] for r in rules):
        # rules of the signature alone: the first pass states everything, a second one finds nothing new
        own = signatures.select("id", F.array_compact(F.array(*holds)).alias("rules"))
        known = F.array_distinct(F.flatten(F.transform("rules", lambda r: r["states"])))
        said = F.flatten(F.transform("rules", lambda r: F.transform(r["states"], lambda fact: F.concat(fact, F.lit("\t"), r["name"]))))
        passes = F.when(F.size("rules") > 0, 2).otherwise(1)
        return own.select("id", known.alias("known"), said.alias("said"), (passes * F.size("rules")).alias("fires"), passes.alias("passes"))
    own = signatures.select("id", F.array_compact(F.array(*holds)).alias("rules"), (given if given is not None else F.array()).cast("array<string>").alias("given"))

    def fire(state: Column, rule: Column) -> Column:
        said = F.transform(rule["states"], lambda fact: F.concat(fact, F.lit("\t"), rule["name"]))
        after = _state(F.array_union(state["known"], rule["states"]), F.array_union(state["said"], said), state["fires"] + 1, state["passes"], state["done"])
        return F.when(F.size(F.array_except(rule["needs"], state["known"])) == 0, after).otherwise(state)

    def one_pass(state: Column) -> Column:
        after = F.aggregate(F.col("rules"), state, fire)
        return F.transform(F.array(after), lambda x: _state(x["known"], x["said"], x["fires"], x["passes"] + 1, F.size(x["known"]) == F.size(state["known"])))[0]

    empty = F.array().cast("array<string>")
    start = _state(F.col("given"), empty, F.lit(0), F.lit(0), F.lit(False))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(most_passes)), start, lambda state, _: F.when(state["done"], state).otherwise(one_pass(state)))
    return own.select("id", end.alias("s")).select("id", "s.known", "s.said", "s.fires", "s.passes")


def derive(signatures: DataFrame, rules=RULES, weight: float = 1.0, most_passes: int = MOST_PASSES) -> DataFrame:
    """Facts of each signature: id, predicate, argument, weight, origins (rule names).

    A fact that several rules state is one row with the largest weight."""
    said = chained(signatures, rules, most_passes).select("id", F.explode("said").alias("x"))
    fact, origin = F.substring_index("x", "\t", 1), F.substring_index("x", "\t", -1)
    at = F.instr(fact, ":")
    return upserted(said.select("id", F.substr(fact, F.lit(1), at - 1).alias("predicate"), F.substr(fact, at + 1).alias("argument"), F.lit(weight).alias("weight"), origin.alias("origin")))


def upserted(facts: DataFrame) -> DataFrame:
    return facts.groupBy("id", "predicate", "argument").agg(F.max("weight").alias("weight"), F.array_join(F.array_sort(F.collect_set("origin")), "|").alias("origins"))


def fired(signatures: DataFrame, rules=RULES, most_passes: int = MOST_PASSES) -> DataFrame:
    """How often rules fire per signature, and the passes until nothing is new."""
    return chained(signatures, rules, most_passes).select("id", "fires", "passes")


def effects(facts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Effects of class profiles (class, kind, family, weight) on signatures with facts.

    required and absent, or forbidden and present: block at the full weight; boosted
    and weakened ones present: a quarter of it. Each (class, effect, reason) once.
    Families that are there meet profiles in an equi-join; only those that lack give
    rows without one, so no signature is multiplied by all profiles."""
    there = facts.filter("predicate = 'family'").select("id", F.col("argument").alias("family")).distinct()
    met = there.join(profiles.filter("kind <> 'required'"), "family")
    required = profiles.filter("kind = 'required'").agg(F.coalesce(F.collect_set(F.struct("class", "kind", "family", "weight")), F.array()).alias("r")).scalar()
    families = facts.groupBy("id").agg(F.collect_set(F.when(F.col("predicate") == "family", F.col("argument"))).alias("families"))
    lacking = families.withColumn("required", required).select("id", F.explode(F.filter("required", lambda x: ~F.array_contains("families", x["family"]))).alias("x")).select("id", "x.*")
    rows = met.select("id", "class", "kind", "family", "weight").unionByName(lacking)
    blocks = F.col("kind").isin("required", "forbidden")
    strength = F.when(blocks, F.col("weight")).otherwise(F.col("weight") * 0.25)
    return rows.select("id", "class", F.when(blocks, "block").otherwise(F.col("kind")).alias("effect"), strength.alias("strength"), F.concat_ws(":", "kind", "family").alias("reason")).dropDuplicates(["id", "class", "effect", "reason"])


def explanation(facts: DataFrame) -> DataFrame:
    """One text per signature: its facts in order."""
    said = F.concat("predicate", F.lit("("), "argument", F.lit(")"))
    return facts.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(said)), "; ").alias("explanation"), F.count("*").alias("facts"))


def rank_in(keys: list[str], *order) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
