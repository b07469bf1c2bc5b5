"""Panels of annotators: matrices of votes, agreement with a reference and with people, stability over repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.operators.metrics import n
from assay.schema import is_preserving

AXES = ("quality_changed", "action_changed")


def panel_matrix(pairs: DataFrame, models: list[str], votes: DataFrame, attempts: DataFrame) -> DataFrame:
    """A row per pair and model (a few models): ``success`` with a vote, else the status of the last attempt (pair_id, model, attempt, status), else ``not_run``."""
    slots = pairs.select("pair_id").distinct().select("pair_id", F.explode(F.array(*map(F.lit, models))).alias("model"))
    last = attempts.groupBy("pair_id", "model").agg(F.max_by("status", "attempt").alias("last"))
    done = votes.select("pair_id", "model").distinct().withColumn("voted", F.lit(True))
    out = slots.join(done, ["pair_id", "model"], "left").join(last, ["pair_id", "model"], "left")
    return out.select("pair_id", "model", F.when(F.col("voted"), "success").otherwise(F.coalesce("last", F.lit("not_run"))).alias("status"))


def category(quality, action):
    """Category of a pair from yes, no or anything else on both axes."""
    unsure = ~quality.isin("yes", "no") | ~action.isin("yes", "no")
    return F.when(unsure, "uncertain").when((quality == "yes") & (action == "yes"), "both").when(quality == "yes", "quality_only").when(action == "yes", "action_only").otherwise("neither")


def category_counts(majorities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs per operator and category of their majority; ``pairs``: pair_id, operator."""
    return majorities.select("pair_id", "category").join(pairs.select("pair_id", "operator"), "pair_id").groupBy("operator", "category").agg(F.count("*").alias("n"))


def reference_agreement(votes: DataFrame, reference: DataFrame) -> DataFrame:
    """Per model of ``votes`` (card_id, model, action, confidence, claims: map of statuses): matches with ``reference`` (card_id, action, confidence, claims)."""
    both = votes.join(reference.select("card_id", *(F.col(c).alias(f"ref_{c}") for c in ("action", "confidence", "claims"))), "card_id")
    same = F.expr("size(filter(map_entries(claims), x -> x.value <=> ref_claims[x.key]))")
    return both.groupBy("model").agg(
        F.count("*").alias("valid_votes"), n(F.col("action") == F.col("ref_action")).alias("action_matches"), n(F.col("confidence") == F.col("ref_confidence")).alias("confidence_matches"),
        F.sum(F.size("claims")).alias("claims"), F.sum(same).alias("claim_matches"),
    )


def reference_transitions(votes: DataFrame, reference: DataFrame) -> DataFrame:
    """How often each model turned an action of the reference into another."""
    both = votes.join(reference.select("card_id", F.col("action").alias("ref_action")), "card_id")
    return both.groupBy("model", F.concat("ref_action", F.lit(" -> "), "action").alias("transition")).agg(F.count("*").alias("n"))


def disputed_cards(votes: DataFrame, reference: DataFrame, models: int) -> DataFrame:
    """Cards that all models voted on, and how many of them any model disputes by action or by a claim."""
    both = votes.join(reference.select("card_id", F.col("action").alias("ref_action"), F.col("claims").alias("ref_claims")), "card_id")
    claim = F.expr("exists(map_entries(claims), x -> not (x.value <=> ref_claims[x.key]))")
    cards = both.groupBy("card_id").agg(F.countDistinct("model").alias("m"), F.bool_or(F.col("action") != F.col("ref_action")).alias("a"), F.bool_or(claim).alias("c")).where(F.col("m") == models)
    return cards.agg(F.count("*").alias("complete_cards"), n(F.col("a")).alias("action_disputes"), n(F.col("c")).alias("claim_disputes"))


def human_model_agreement(human: DataFrame, votes: DataFrame) -> DataFrame:
    """Per model: pairs that both judged, and matches on either axis; both have pair_id, quality_changed, action_changed."""
    both = votes.join(human.select("pair_id", *(F.col(a).alias(f"h_{a}") for a in AXES)), "pair_id")
    return both.groupBy("model").agg(F.count("*").alias("valid_pairs"), *(n(F.col(a) == F.col(f"h_{a}")).alias(f"{a}_matches") for a in AXES))


def human_majority_agreement(human: DataFrame, votes: DataFrame, models: int = 3) -> DataFrame:
    """Over pairs that all models voted on: definite majorities of each axis and how many a person shares, and the same of categories."""
    counts = [n(F.col(a) == v).alias(f"{a}_{v}") for a in AXES for v in ("yes", "no")]
    pairs = votes.groupBy("pair_id").agg(F.countDistinct("model").alias("m"), *counts).where(F.col("m") == models)
    for a in AXES:
        pairs = pairs.withColumn(a, F.when(F.col(f"{a}_yes") >= 2, "yes").when(F.col(f"{a}_no") >= 2, "no"))
    both = pairs.join(human.select("pair_id", *(F.col(a).alias(f"h_{a}") for a in AXES)), "pair_id")
    sure = F.col(AXES[0]).isNotNull() & F.col(AXES[1]).isNotNull()
    same = category(F.col(AXES[0]), F.col(AXES[1])) == category(F.col(f"h_{AXES[0]}"), F.col(f"h_{AXES[1]}"))
    out = [x for a in AXES for x in (n(F.col(a).isNotNull()).alias(f"{a}_definite"), n(F.col(a) == F.col(f"h_{a}")).alias(f"{a}_matches"))]
    return both.agg(F.count("*").alias("complete_pairs"), *out, n(sure).alias("definite_categories"), n(sure & same).alias("category_matches"))


def repeat_agreement(cases: DataFrame, runs: DataFrame, repeats: int = 3) -> DataFrame:
    """Per kind and operator of ``cases`` (case_id, case_kind, operator): eligible, complete and changed over ``runs`` (case_id, repeat_index, decision).

    A case is complete with ``repeats`` repeats or more, and changed if any of all its repeats differs.
    """
    seen = runs.groupBy("case_id").agg(F.countDistinct("repeat_index").alias("r"), F.countDistinct("decision").alias("d"))
    rows = cases.select("case_id", "case_kind", F.coalesce("operator", F.lit("canonical")).alias("operator")).join(seen, "case_id", "left")
    whole = F.coalesce(F.col("r") >= repeats, F.lit(False))
    return rows.groupBy("case_kind", "operator").agg(F.count("*").alias("eligible"), n(whole).alias("complete"), n(whole & (F.col("d") > 1)).alias("changed"))


def repeat_drift(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """Per repeat: preserving cases (case_id, parent_id, preserving), those whose own and parent's decision are there, and how many differ."""
    eligible = cases.where("preserving").select("case_id", "parent_id")
    every = runs.select("repeat_index").distinct()
    own = eligible.join(runs.select("case_id", "repeat_index", "decision"), "case_id")
    parent = runs.select(F.col("case_id").alias("parent_id"), "repeat_index", F.col("decision").alias("parent_decision"))
    paired = own.join(parent, ["parent_id", "repeat_index"]).groupBy("repeat_index").agg(F.count("*").alias("paired"), n(F.col("decision") != F.col("parent_decision")).alias("changed"))
    out = every.withColumn("eligible", F.lit(eligible.count()).cast("long")).join(paired, "repeat_index", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("repeat_index", "eligible", zero("paired").alias("paired"), (F.col("eligible") - zero("paired")).alias("missing_pairs"), zero("changed").alias("changed"))


def preserving_inventory(records: DataFrame, specs: DataFrame) -> DataFrame:
    """Per operator: decision-preserving cases, and how many of them carry a negative authored delta (``specs``: operator, negative_delta) or remove
    a required version (``required_versions`` of a record)."""
    rows = records.where(is_preserving()).join(F.broadcast(specs), "operator", "left")
    removes = (F.col("operator") == "remove_affected_version") & F.col("required_versions")
    return rows.groupBy("operator").agg(F.count("*").alias("preserving"), n(F.coalesce("negative_delta", F.lit(False))).alias("negative_delta"), n(F.coalesce(removes, F.lit(False))).alias("removes_required_version"))


def text_pairs(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(case_id, a, b, swapped): texts of preserving children (case_id, parent_id, text) and their parents (case_id, text); the parity of the id's SHA-256
    decides which stands first, and equal texts are left to :func:`equal_pairs`."""
    both = children.join(parents.select(F.col("case_id").alias("parent_id"), F.col("text").alias("parent_text")), "parent_id")
    swapped = F.conv(F.substring(F.sha2("case_id", 256), 64, 1), 16, 10).cast("int") % 2 == 1
    return both.select("case_id", F.when(swapped, F.col("text")).otherwise(F.col("parent_text")).alias("a"), F.when(swapped, F.col("parent_text")).otherwise(F.col("text")).alias("b"), swapped.alias("swapped"))


def equal_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs whose texts are equal, which nobody can judge."""
    return pairs.where("a = b").select("case_id")
