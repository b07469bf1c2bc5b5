"""Record schema and fixed vocabularies.

A record is one evaluator's decision on one case in one repeat; its key is
(case_id, evaluator_name, repeat_index).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that results must carry.
ACCEPT, REJECT, REVIEW = "accept", "reject", "needs_manual_review"
DECISIONS = (ACCEPT, REJECT, REVIEW)
CLASS_DEFAULT = {"valid": ACCEPT, "invalid": REJECT, "review": REVIEW}
DIMENSIONS = ("reproducibility", "evidence_completeness", "claim_evidence_consistency", "impact_calibration", "scope_consistency")
PRESENTATION_OPERATORS = ("professionalize_language", "professionalize_style", "confidence_overstatement")
#: (expected, decided) to the name of the error.
ERROR_CODES = {
    (ACCEPT, REJECT): "over_rejection",
    (ACCEPT, REVIEW): "premature_deferral",
    (REJECT, ACCEPT): "false_reassurance",
    (REJECT, REVIEW): "deferred_invalid",
    (REVIEW, ACCEPT): "premature_accept",
    (REVIEW, REJECT): "over_strict_reject",
}

FINDING = T.StructType([T.StructField(n, T.StringType()) for n in ("code", "severity", "evidence", "message")])
RECORD = T.StructType([
    T.StructField("case_id", T.StringType()), T.StructField("case_kind", T.StringType()), T.StructField("parent_id", T.StringType()),
    T.StructField("operator", T.StringType()), T.StructField("report_class", T.StringType()), T.StructField("expected_decision", T.StringType()),
    T.StructField("expected_dimensions", T.MapType(T.StringType(), T.DoubleType())), T.StructField("seed", T.DecimalType(20, 0)),
    T.StructField("evaluator_name", T.StringType()), T.StructField("evaluator_version", T.StringType()), T.StructField("decision", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("dimensions", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("correct", T.BooleanType()), T.StructField("findings", T.ArrayType(FINDING)), T.StructField("rationale", T.StringType()),
    T.StructField("repeat_index", T.IntegerType()), T.StructField("row_id", T.LongType()),
])
SECTION = T.StructType([
    T.StructField("heading", T.StringType()), T.StructField("level", T.IntegerType()),
    T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("text", T.StringType()),
])


def class_default(report_class: Column | str) -> Column:
    """Expected decision of a report class; unknown classes go to review."""
    c = F.col(report_class) if isinstance(report_class, str) else report_class
    return F.when(c == "valid", ACCEPT).when(c == "invalid", REJECT).otherwise(REVIEW)


def is_correct(expected: str = "expected_decision", decision: str = "decision") -> Column:
    return F.coalesce(F.col(expected) == F.col(decision), F.lit(False))


def is_changing() -> Column:
    """Mutated rows whose target differs from their class default."""
    e = F.col("expected_decision")
    return (F.col("case_kind") == "mutated") & e.isNotNull() & F.col("operator").isNotNull() & (e != class_default("report_class"))


def is_preserving() -> Column:
    """Mutated rows with a parent whose target is their class default."""
    e = F.col("expected_decision")
    return (F.col("case_kind") == "mutated") & e.isNotNull() & F.col("parent_id").isNotNull() & (e == class_default("report_class"))


def is_presentation() -> Column:
    """Rows of presentation operators that should not be accepted."""
    e = F.col("expected_decision")
    return F.col("operator").isin(*PRESENTATION_OPERATORS) & e.isNotNull() & (e != ACCEPT) & F.col("parent_id").isNotNull()
