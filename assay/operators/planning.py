"""Planning of mutations: policies, rotation over operators, seeds and case ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.hashing import derived_seed
from assay.operators.integrity import require_none
from assay.storage import stored


def with_policy(fixtures: DataFrame, policies: DataFrame) -> DataFrame:
    """``policy`` of every fixture (fixture_id, pair_id, report_class): that of its pair, else of its class; others are an error."""
    keys = policies.select("policy")
    out = fixtures.join(keys.withColumnRenamed("policy", "pair_policy"), F.col("pair_id") == F.col("pair_policy"), "left")
    out = out.join(keys.withColumnRenamed("policy", "class_policy"), F.col("report_class") == F.col("class_policy"), "left")
    out = out.withColumn("policy", F.coalesce("pair_policy", "class_policy")).drop("pair_policy", "class_policy")
    require_none(out.where("policy is null").select("fixture_id"), "no policy covers the fixture")
    return out


def rotation(fixtures: DataFrame, policies: DataFrame) -> DataFrame:
    """A row per fixture and variant: the operator at (ordinal within the policy + variant) modulo the policy's operators.

    fixtures: fixture_id, short_name, policy; policies (a few rows): policy, variants, operators.
    """
    rows = ranked(fixtures, ["fixture_id"], "policy").withColumnRenamed("place", "ordinal").join(policies, "policy").where("variants > 0")
    rows = rows.withColumn("variant", F.explode(F.sequence(F.lit(0), F.col("variants") - 1)))
    operator = F.element_at("operators", (F.pmod(F.col("ordinal") + F.col("variant"), F.size("operators")) + 1).cast("int"))
    rows = rows.withColumn("operator", operator).drop("operators", "variants", "ordinal")
    return rows.withColumn("case_id", case_id(F.col("short_name"), F.col("operator"), F.col("variant")))


def case_id(short_name: Column, operator: Column, variant: Column) -> Column:
    return F.concat(F.lit("mut-"), short_name, F.lit("-"), F.replace(operator, F.lit("_"), F.lit("-")), F.lit("-"), F.lpad((variant + 1).cast("string"), 2, "0"))


def with_seeds(plan: DataFrame, base_seed: int) -> DataFrame:
    return plan.withColumn("seed", derived_seed(F.lit(str(base_seed)), F.col("fixture_id"), F.col("operator"), F.col("variant").cast("string")))


def estimated_cases(fixtures: DataFrame, policies: DataFrame) -> DataFrame:
    return fixtures.groupBy("policy").agg(F.count("*").alias("fixtures")).join(policies, "policy").select("policy", "fixtures", (F.col("fixtures") * F.col("variants")).alias("cases"))


def materialization_status(applied: DataFrame) -> DataFrame:
    """``status`` of applied plans (case_id, ordinal, error, note, text, parent_text, unsafe): the first that holds of duplicate, error, no_op, safety_blocked, else written."""
    first = F.row_number().over(Window.partitionBy("case_id").orderBy("ordinal")) == 1
    status = (
        F.when(~F.col("first"), "duplicate").when(F.col("error").isNotNull(), "error").when(F.col("note").isNotNull() | F.col("text").eqNullSafe(F.col("parent_text")), "no_op")
        .when(F.col("unsafe"), "safety_blocked").otherwise("written")
    )
    return applied.withColumn("first", first).withColumn("status", status).drop("first")


def ledger_tallies(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count("*").alias("n"))


#: Rows of a range that is numbered by one task.
PER_RANGE = 100_000


def ranked(rows: DataFrame, order: list[str], by: str | None = None) -> DataFrame:
    """``rows`` with ``place``, their number from 0 on in the order of the columns ``order``, within each value of ``by``.

    Rows are dealt into ranges of the order, as many as they need, and stored with the number of their range; a place is the rank within a range and how many rows
    of the group the ranges before hold (a row for each range and group).  So no task holds a whole group.
    """
    keys = ([by] if by else []) + list(order)
    ranges = 1 + rows.count() // PER_RANGE
    dealt = stored(rows.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    group = [by] if by else []
    sizes = dealt.groupBy(*group, "_range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*(F.col(g).alias(f"_{g}") for g in group), F.col("_range").alias("_of"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)) - 1
    same = F.col("_range") == F.col("_of")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return dealt.withColumn("_within", within).join(before, same).withColumn("place", F.col("_before") + F.col("_within")).select(*rows.columns, "place")


def numbered(rows: DataFrame, key: Column) -> DataFrame:
    """``rows`` with ``place``, their number from 0 on in the order of the SHA-256 of ``key``."""
    return ranked(rows.withColumn("_hash", F.sha2(key, 256)), ["_hash"]).drop("_hash")


def hash_batches(rows: DataFrame, key: Column, size: int) -> DataFrame:
    """Rows in hash order, cut into batches of ``size``."""
    return numbered(rows, key).withColumn("batch", F.floor(F.col("place") / size)).drop("place")


def eligibility(specs: DataFrame) -> DataFrame:
    """What each operator of ``specs`` (operator, category, degrading, presentation) can be measured by."""
    note = (
        F.when(F.col("presentation"), "accepting broken content more often counts; equal decisions say nothing about quality")
        .when(F.col("degrading"), "equal decisions are misses").otherwise("equal decisions are stability only")
    )
    return specs.select("operator", "category", "degrading", "presentation", F.col("degrading").alias("detection_eligible"), F.col("presentation").alias("susceptibility_eligible"), note.alias("invariance"))


def plan_counts(plan: DataFrame) -> DataFrame:
    """Cases per policy of a :func:`rotation`."""
    return plan.groupBy("policy").agg(F.count("*").alias("cases"), F.countDistinct("fixture_id").alias("fixtures"))


def case_slice(cases: DataFrame, offset: int, most: int) -> DataFrame:
    """Cases offset .. offset + most - 1 by case_id; an offset beyond the last case is an error."""
    rows = ranked(cases.select("case_id").distinct(), ["case_id"])
    if offset < 0 or most < 1 or not rows.where(F.col("place") >= offset).take(1):
        raise ValueError("the slice is outside the cases")
    kept = rows.where((F.col("place") >= offset) & (F.col("place") < offset + most)).select("case_id")
    return cases.join(kept, "case_id", "left_semi")


def dimension_deltas(base: Column, deltas: dict[str, float]) -> Column:
    """Dimension map with deltas added (0.5 where the base lacks one), rounded to thousandths, within [0, 1]."""
    names = sorted(deltas)
    changed = F.map_from_arrays(
        F.array(*map(F.lit, names)),
        F.array(*(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.coalesce(F.try_element_at(base, F.lit(d)), F.lit(0.5)) + deltas[d], 3))) for d in names)),
    ) if names else F.create_map().cast("map<string,double>")
    kept = F.map_filter(base, lambda k, v: ~k.isin(*names)) if names else base
    return F.map_concat(kept, changed) if names else base
