"""Paired comparisons: decision changes, authored pairs, evaluator against evaluator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.operators import evaluators, mutations
from assay.operators.metrics import n, ratio, with_parents
from assay.schema import ACCEPT, REVIEW, is_changing, is_correct


def decision_change_audit(records: DataFrame) -> DataFrame:
    """Children whose target changes, against their parents, per evaluator."""
    rows = with_parents(records.where(is_changing() & F.col("parent_id").isNotNull()), records)
    paired = F.col("p_id").isNotNull()
    child_ok, parent_ok = is_correct(), is_correct("parent_expected", "parent_decision")
    out = rows.groupBy("evaluator_name").agg(
        F.count("*").alias("eligible_children"), n(paired).alias("paired"), n(~paired).alias("missing_parent"), n(child_ok).alias("child_correct"),
        n(parent_ok).alias("parent_correct"), n(child_ok & parent_ok).alias("both_correct"),
        n(F.col("decision") != F.col("parent_decision")).alias("decision_changed"), n(F.col("decision") == REVIEW).alias("child_deferrals"),
    )
    return out.select(
        "*", ratio("child_correct", "eligible_children").alias("child_target_accuracy"), ratio("both_correct", "paired").alias("both_correct_rate"),
        ratio("decision_changed", "paired").alias("decision_change_rate"), ratio("both_correct", "parent_correct").alias("child_given_parent_correct"),
        ratio("child_deferrals", "eligible_children").alias("deferral_rate"),
    )


def authored_pairs(records: DataFrame, roles: DataFrame) -> DataFrame:
    """Canonical rows of authored pairs side by side, from ``roles`` (case_id, pair_id, pair_role plain or polished)."""
    rows = records.where("case_kind = 'canonical'").join(roles, "case_id")
    keys = ["evaluator_name", "pair_id", "repeat_index"]
    side = [F.max(F.when(F.col("pair_role") == r, F.col(c))).alias(f"{r}_{c}") for r in ("plain", "polished") for c in ("decision", "expected_decision")]
    return rows.groupBy(*keys).agg(F.count("*").alias("members"), F.countDistinct("pair_role").alias("distinct_roles"), *side)


def authored_pair_violations(records: DataFrame, roles: DataFrame) -> DataFrame:
    """Pairs that are incomplete, have a role twice or unequal targets."""
    p = authored_pairs(records, roles)
    bad = (F.col("members") != 2) | (F.col("distinct_roles") != 2) | ~F.col("plain_expected_decision").eqNullSafe(F.col("polished_expected_decision"))
    return p.where(bad)


def authored_pair_audit(records: DataFrame, roles: DataFrame) -> DataFrame:
    p = authored_pairs(records, roles).where((F.col("members") == 2) & (F.col("distinct_roles") == 2))
    a, b = F.col("plain_decision"), F.col("polished_decision")
    ok = is_correct("plain_expected_decision", "plain_decision") & is_correct("polished_expected_decision", "polished_decision")
    return p.groupBy("evaluator_name").agg(
        F.count("*").alias("paired"), n(a != b).alias("changed"), n(ok).alias("both_correct"), n(a == ACCEPT).alias("plain_accept"), n(b == ACCEPT).alias("polished_accept"),
        n((a != ACCEPT) & (b == ACCEPT)).alias("accept_gain"), n((a == ACCEPT) & (b != ACCEPT)).alias("accept_loss"),
    )


def transitions(records: DataFrame, roles: DataFrame) -> DataFrame:
    """Histogram of plain to polished decisions."""
    p = authored_pairs(records, roles).where((F.col("members") == 2) & (F.col("distinct_roles") == 2))
    return p.groupBy("evaluator_name", F.concat("plain_decision", F.lit(" -> "), "polished_decision").alias("transition")).agg(F.count("*").alias("n"))


def paired_win_loss(records: DataFrame) -> DataFrame:
    """For all pairs of evaluators, a before b by name: who alone is correct on shared, scored cases."""
    rows = records.where("expected_decision is not null")
    a = rows.select("case_id", "repeat_index", F.col("evaluator_name").alias("evaluator_a"), is_correct().alias("ok_a"))
    b = rows.select("case_id", "repeat_index", F.col("evaluator_name").alias("evaluator_b"), is_correct().alias("ok_b"))
    both = a.join(b, ["case_id", "repeat_index"]).where("evaluator_a < evaluator_b")
    out = both.groupBy("evaluator_a", "evaluator_b").agg(
        F.count("*").alias("cases"), n(F.col("ok_a") & ~F.col("ok_b")).alias("a_wins"), n(~F.col("ok_a") & F.col("ok_b")).alias("b_wins"), n(F.col("ok_a") == F.col("ok_b")).alias("ties"),
    )
    return out.withColumn("a_win_rate", F.coalesce(ratio(F.col("a_wins"), F.col("a_wins") + F.col("b_wins")), F.lit(0.0)))


def decision_matrix(records: DataFrame) -> DataFrame:
    """For all pairs of evaluators: how often one decides x where the other decides y."""
    a = records.select("case_id", "repeat_index", F.col("evaluator_name").alias("evaluator_a"), F.col("decision").alias("decision_a"))
    b = records.select("case_id", "repeat_index", F.col("evaluator_name").alias("evaluator_b"), F.col("decision").alias("decision_b"))
    both = a.join(b, ["case_id", "repeat_index"]).where("evaluator_a < evaluator_b")
    return both.groupBy("evaluator_a", "evaluator_b", "decision_a", "decision_b").agg(F.count("*").alias("n"))


def constant_policies(records: DataFrame) -> DataFrame:
    """Agreement of evaluators that always decide the same, on the cases of one evaluator."""
    from assay.schema import DECISIONS

    cases = records.where("expected_decision is not null")
    out = cases.select(is_changing().alias("changing"), "expected_decision", F.explode(F.array(*map(F.lit, DECISIONS))).alias("decision"))
    out = out.groupBy(F.concat(F.lit("always-"), "decision").alias("policy")).agg(
        F.count("*").alias("total"), n(is_correct()).alias("correct"), n(F.col("changing")).alias("changing"), n(F.col("changing") & is_correct()).alias("changing_correct"),
    )
    return out.select("*", ratio("correct", "total").alias("agreement"), ratio("changing_correct", "changing").alias("target_accuracy"))


def results_pivot(records: DataFrame, names: list[str]) -> DataFrame:
    """Operator by evaluator matrix of accuracy; canonical rows are their own line."""
    rows = records.where("expected_decision is not null").withColumn("operator", F.coalesce("operator", F.lit("canonical")))
    out = rows.groupBy("operator").pivot("evaluator_name", names).agg(n(is_correct()).alias("correct"), F.count("decision").alias("total"))
    return out.select("operator", *(ratio(f"{e}_correct", f"{e}_total").alias(f"accuracy_{e}") for e in names))


def comparison(bundle: DataFrame, sources: list[str], source: str = "evaluator_name") -> DataFrame:
    """A row per metric of ``bundle`` (one row per source) and a column per source; metrics that are not defined are NULL."""
    if len(set(sources)) < len(sources):
        raise ValueError("a source is named twice")
    names = [c for c in bundle.columns if c != source]
    long = bundle.select(source, *(F.col(c).cast("double").alias(c) for c in names)).unpivot(source, names, "metric", "value")
    return long.groupBy("metric").pivot(source, sources).agg(F.first("value"))


def comparison_markdown(bundle: DataFrame, sources: list[str], source: str = "evaluator_name") -> str:
    """The comparison as a Markdown table of a few rows; values are rounded here only."""
    rows = comparison(bundle, sources, source).orderBy("metric").collect()
    shown = lambda v: "n/a" if v is None else f"{v:.4f}"
    return "\n".join([f"| metric | {' | '.join(sources)} |", "|" + "-|" * (len(sources) + 1), *(f"| {r['metric']} | {' | '.join(shown(r[s]) for s in sources)} |" for r in rows)]) + "\n"


# The arms of an intervention, by the rewrites that make them of the original.
ARMS = {"style": "professionalize_style", "cue": "add_authorization_preamble", "composite": "professionalize_language"}


def intervention_arms(reports: DataFrame) -> DataFrame:
    """(case_id, arm, raw_text) of ``reports`` (case_id, raw_text): as they are, in another style, with a cue, and with both by the one rewrite that has both."""
    plan = reports.select("case_id", F.lit("f").alias("fixture_id"), F.explode(F.array(*map(F.lit, ARMS.values()))).alias("operator"), F.lit(0).cast("decimal(20,0)").alias("seed"), "raw_text")
    name = F.element_at(F.create_map(*(F.lit(x) for arm, o in ARMS.items() for x in (o, arm))), F.col("operator"))
    made = mutations.applied(plan).select("case_id", name.alias("arm"), F.col("text").alias("raw_text"))
    return reports.select("case_id", F.lit("original").alias("arm"), "raw_text").unionByName(made)


def composite_problems(arms: DataFrame) -> DataFrame:
    """(case_id) of cases whose composite arm is not the cue put into the styled text."""
    styled = arms.where("arm = 'style'").select("case_id", F.lit("f").alias("fixture_id"), F.lit(ARMS["cue"]).alias("operator"), F.lit(0).cast("decimal(20,0)").alias("seed"), "raw_text")
    again = mutations.applied(styled).select("case_id", F.col("text").alias("again"))
    end = lambda c: F.regexp_replace(c, r"\n+\z", "")
    return arms.where("arm = 'composite'").join(again, "case_id", "full_outer").where(~end(F.col("raw_text")).eqNullSafe(end(F.col("again")))).select("case_id")


def intervention_audit(arms: DataFrame, evaluator: evaluators.Evaluator = evaluators.RULES) -> DataFrame:
    """Per arm: total, accepted, texts that differ from the original, and decisions that do; a case's arms meet in one grouping, so there is no join."""
    case = F.struct("case_id", "arm", F.sha2("raw_text", 256).alias("digest"))  # beside the name, so that an arm's text is made once
    named = evaluators.structured(arms.select(F.to_json(case).alias("report_id"), "raw_text"))
    told = evaluator.apply(named).select(F.from_json("report_id", "case_id string, arm string, digest string").alias("x"), "decision").select("x.*", "decision")
    rows = told.groupBy("case_id", "arm").agg(F.max("digest").alias("digest"), F.max("decision").alias("decision"))
    original = Window.partitionBy("case_id")
    first = lambda c: F.max(F.when(F.col("arm") == "original", F.col(c))).over(original)
    rows = rows.withColumns({"own_digest": first("digest"), "own_decision": first("decision")})
    return rows.groupBy("arm").agg(
        F.count("*").alias("total"), n(F.col("decision") == ACCEPT).alias("accepted"), n(F.col("digest") != F.col("own_digest")).alias("text_changed"), n(F.col("decision") != F.col("own_decision")).alias("decision_changed"),
    )
