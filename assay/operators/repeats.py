"""Outcome ledgers and repeats: coverage, stability, variance, failures, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.operators.metrics import n, ratio


def repeat_stability(records: DataFrame, repeats: int, by: tuple[str, ...] = ("evaluator_name",)) -> DataFrame:
    """Unanimous, flipped and incomplete cases over ``repeats`` repeats; the rate divides by all cases, ``complete_rate`` by complete ones."""
    cases = records.groupBy(*by, "case_id").agg(
        F.countDistinct("repeat_index").alias("seen"), F.countDistinct("decision").alias("decisions"),
        (F.max("confidence") - F.min("confidence")).alias("spread"),
    )
    whole = F.col("seen") >= repeats
    out = cases.groupBy(*by).agg(
        F.count("*").alias("cases_compared"), n(whole & (F.col("decisions") == 1)).alias("unanimous"), n(whole & (F.col("decisions") > 1)).alias("flipped"), n(~whole).alias("incomplete"),
        F.sum(F.when(whole, F.round(F.col("spread") * 1_000_000).cast("long"))).alias("t"),
    )
    complete = F.col("unanimous") + F.col("flipped")
    return out.select(
        *by, "cases_compared", "unanimous", "flipped", "incomplete", ratio("unanimous", "cases_compared").alias("unanimity_rate"),
        ratio(F.col("unanimous"), complete).alias("complete_rate"), F.coalesce(ratio(F.coalesce("t", F.lit(0)), complete) / 1_000_000, F.lit(0.0)).alias("mean_spread"),
    )


def case_variance(outcomes: DataFrame) -> DataFrame:
    """Per condition and case of ``outcomes`` (condition, case_id, repeat_index, status, decision, units: confidence in 1/10000):
    statuses, decisions, mean, population variance numerator and range of confidence, flip."""
    ok = F.col("status") == "success"
    out = outcomes.groupBy("condition", "case_id").agg(
        n(ok).alias("successes"), n(F.col("status") == "failed").alias("failures"), n(F.col("status") == "not_run").alias("not_run"),
        F.countDistinct(F.when(ok, F.col("decision"))).alias("decisions"), F.sum(F.when(ok, F.col("units"))).alias("s"),
        F.sum(F.when(ok, F.col("units") * F.col("units"))).alias("ss"), (F.max(F.when(ok, F.col("units"))) - F.min(F.when(ok, F.col("units")))).alias("spread"),
    )
    # counts and sums are whole numbers, so the moments do not depend on the order of rows
    variance = (F.col("ss") * F.col("successes") - F.col("s") * F.col("s")).cast("double") / F.nullif((F.col("successes") * F.col("successes")).cast("double"), F.lit(0.0))
    return out.select(
        "condition", "case_id", "successes", "failures", "not_run", ratio("s", "successes").alias("mean_units"), F.sqrt(variance).alias("sd_units"), F.col("spread").alias("range_units"),
        (F.col("decisions") > 1).alias("flip"),
    )


def flip_rate(variance: DataFrame) -> DataFrame:
    """Share of flips among complete cases with two observations at least."""
    ready = (F.col("failures") == 0) & (F.col("not_run") == 0) & (F.col("successes") >= 2)
    out = variance.groupBy("condition").agg(n(ready).alias("complete_cases"), n(ready & F.col("flip")).alias("flips"), n(~ready).alias("left_out"))
    return out.withColumn("flip_rate", ratio("flips", "complete_cases"))


def outcome_coverage(outcomes: DataFrame) -> DataFrame:
    """planned = success + failed + not_run, and whether everything succeeded or failed."""
    s = F.col("status")
    out = outcomes.groupBy("condition").agg(F.count("*").alias("planned"), n(s == "success").alias("success"), n(s == "failed").alias("failed"), n(s == "not_run").alias("not_run"))
    return out.withColumn("complete", F.col("not_run") == 0)


def failure_histogram(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("status = 'failed'").groupBy("condition", "error_kind").agg(F.count("*").alias("n"))


def planned_not_seen(cases: DataFrame, outcomes: DataFrame, repeats: int) -> DataFrame:
    """Planned (case, repeat) slots without an outcome: the cases times a few repeats, less what is there."""
    planned = cases.select("condition", "case_id", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat_index"))
    return planned.join(outcomes.select("condition", "case_id", "repeat_index"), ["condition", "case_id", "repeat_index"], "left_anti")


def outcome_mismatches(outcomes: DataFrame, records: DataFrame) -> DataFrame:
    """Successes without a record and records without a success, from a full outer join on the slot."""
    good = outcomes.where("status = 'success'").select("case_id", "repeat_index", F.lit(True).alias("succeeded"))
    there = records.select("case_id", "repeat_index", F.lit(True).alias("recorded"))
    both = good.join(there, ["case_id", "repeat_index"], "full_outer").where("succeeded is null or recorded is null")
    return both.select("case_id", "repeat_index", F.when(F.col("recorded").isNull(), "success_without_record").otherwise("record_without_success").alias("problem"))


def attempt_gaps(attempts: DataFrame) -> DataFrame:
    """Rows of (slot, attempt) whose attempt is not its rank in the slot."""
    w = Window.partitionBy("slot").orderBy("ordinal")
    return attempts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") != F.col("attempt")).drop("ordinal")


def vote_majority(votes: DataFrame, models: int = 3) -> DataFrame:
    """Per pair of ``votes`` (pair_id, model, quality_changed, action_changed): the category of the majority.

    All models must have voted; yes and no need two votes on an axis; anything else is uncertain.
    """
    count = [n(F.col(f"{axis}_changed") == v).alias(f"{axis}_{v}") for axis in ("quality", "action") for v in ("yes", "no")]
    out = votes.groupBy("pair_id").agg(F.countDistinct("model").alias("voted"), *count)

    def major(axis):
        return F.when(F.col(f"{axis}_yes") >= 2, "yes").when(F.col(f"{axis}_no") >= 2, "no").otherwise("uncertain")

    q, a = major("quality"), major("action")
    category = (
        F.when(F.col("voted") < models, "incomplete").when((q == "uncertain") | (a == "uncertain"), "uncertain")
        .when((q == "yes") & (a == "yes"), "both").when(q == "yes", "quality_only").when(a == "yes", "action_only").otherwise("neither")
    )
    most = F.least(F.greatest("quality_yes", "quality_no"), F.greatest("action_yes", "action_no"))
    return out.select("pair_id", "voted", category.alias("category"), ((F.col("voted") >= models) & (most < models)).alias("dissent"))


def top_k(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first ``k`` rows of every group; Spark keeps k per task before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
