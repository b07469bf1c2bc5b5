"""Integrity checks as data: each returns the rows that break a rule; :func:`require_none` raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.schema import is_correct
from assay.storage import dealt

#: Rows that one row becomes in one step.
PART = 10_000


def duplicate_keys(records: DataFrame) -> DataFrame:
    return records.groupBy("case_id", "evaluator_name", "repeat_index").agg(F.count("*").alias("copies")).where("copies > 1")


def drifts() -> Column:
    return ~F.col("correct").eqNullSafe(is_correct())


def correct_flag_drift(records: DataFrame) -> DataFrame:
    return records.where(drifts())


def lacks_link() -> Column:
    return F.expr("case_kind = 'mutated' and (parent_id is null or operator is null)")


def missing_links(records: DataFrame) -> DataFrame:
    return records.where(lacks_link())


def dangling_parents(records: DataFrame) -> DataFrame:
    """Mutated cases whose parent is not a canonical case."""
    known = records.where("case_kind = 'canonical'").select(F.col("case_id").alias("parent_id"))
    return records.where("case_kind = 'mutated'").select("case_id", "parent_id").distinct().join(known, "parent_id", "left_anti")


def odd_pairs(roles: DataFrame) -> DataFrame:
    """pair_ids that do not have exactly two members."""
    return roles.groupBy("pair_id").agg(F.count("*").alias("members")).where("members <> 2")


def violations(records: DataFrame, size: int | None = None) -> DataFrame:
    """(rule, key) of everything that must not be scored, from one scan; a ``size``, which is how many records there are at most, bounds what a task groups."""
    own = ("case_id", "evaluator_name", "repeat_index")
    rows = records.select(*own, drifts().alias("_drifts"), lacks_link().alias("_lacks"))
    sums = (rows if size is None else dealt(rows, size, "case_id")).groupBy(*own).agg(F.count("*").alias("copies"), F.count_if("_drifts").alias("drifting"), F.count_if("_lacks").alias("unlinked"))
    told = (("duplicate_key", F.when(F.col("copies") > 1, 1)), ("correct_flag", F.col("drifting")), ("missing_link", F.col("unlinked")))
    found = sums.select(
        F.concat_ws("|", "case_id", "evaluator_name", F.col("repeat_index").cast("string")).alias("key"),
        F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), times.cast("long").alias("times")) for rule, times in told))).alias("x"),
    ).select("x.*", "key").where("times > 0")
    # as often as there are such rows, by parts, as no array may hold all of a key that is everywhere
    parts = found.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / PART))))
    return parts.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(PART), F.col("times") - F.col("_part") * PART)))).select("rule", "key")


def require_none(found: DataFrame, what: str) -> None:
    """Raises ValueError with an example if ``found`` has rows."""
    row = found.limit(1).collect()
    if row:
        raise ValueError(f"{what}: {row[0].asDict()}")


def canonical_issues(cases: DataFrame) -> DataFrame:
    """(report_id, severity, issue) of structured canonical reports with required_evidence, report_class and reproducible: evidence of an unknown kind or whose
    section is missing, what is unsafe to publish, and valid reports that are not reproducible (a warning)."""
    from assay.functions.safety import violations
    from assay.operators.evaluators import SECTION_PATTERNS, present

    needed = F.coalesce("required_evidence", F.array().cast("array<string>"))

    def issue(when, severity, text):
        return F.when(when, F.struct(F.lit(severity).alias("severity"), text.alias("issue")))

    unknown = F.transform(F.array_except(needed, F.array(*map(F.lit, SECTION_PATTERNS))), lambda k: F.struct(F.lit("error").alias("severity"), F.concat(F.lit("unknown evidence: "), k).alias("issue")))
    missing = [issue(F.array_contains(needed, k) & ~present(k), "error", F.lit(f"no section for {k}")) for k in SECTION_PATTERNS]
    unsafe = F.transform(violations(F.col("raw_text")), lambda v: F.struct(F.lit("error").alias("severity"), F.concat(v.rule, F.lit(": "), v.found).alias("issue")))
    odd = issue((F.col("report_class") == "valid") & ~F.coalesce("reproducible", F.lit(False)), "warning", F.lit("valid but not reproducible"))
    return cases.select("report_id", F.explode(F.concat(unknown, F.array_compact(F.array(*missing, odd)), unsafe)).alias("x")).select("report_id", "x.*")


def derived_issues(cases: DataFrame, prefix: str = "canonical-") -> DataFrame:
    """(report_id, issue) of derived reports (report_id, parent_id, raw_text): a parent of another kind, and what is unsafe to publish."""
    from assay.functions.safety import violations

    parent = F.when(~F.coalesce(F.col("parent_id").startswith(prefix), F.lit(False)), "parent is not canonical")
    unsafe = F.transform(violations(F.col("raw_text")), lambda v: F.concat(v.rule, F.lit(": "), v.found))
    return cases.select("report_id", F.explode(F.concat(F.array_compact(F.array(parent)), unsafe)).alias("issue"))


def sheet_issues(sheet: DataFrame, expected: DataFrame, answers: tuple[str, ...] = ("yes", "no", "uncertain")) -> DataFrame:
    """(pair_id, issue) of a reviewer's sheet (pair_id, quality_changed, action_changed, rationale) against the expected pairs."""
    own = F.array_compact(F.array(
        *(F.when(~F.coalesce(F.col(c).isin(*answers), F.lit(False)), f"{c} is no answer") for c in ("quality_changed", "action_changed")),
        F.when(F.coalesce(F.trim("rationale"), F.lit("")) == "", "no rationale"),
    ))
    found = sheet.select("pair_id", F.explode(own).alias("issue"))
    ids = expected.select("pair_id").distinct().withColumn("e", F.lit(1)).join(sheet.groupBy("pair_id").agg(F.count("*").alias("n")), "pair_id", "full_outer")
    kind = F.when(F.col("e").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return found.unionByName(ids.select("pair_id", kind.alias("issue")).where("issue is not null"))
