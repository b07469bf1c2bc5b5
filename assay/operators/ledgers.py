"""Ledgers of planned work: indexes, outcomes and their reconciliation, as rows that break a rule."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators.integrity import require_none

STATUSES = ("written", "no_op", "duplicate", "safety_blocked", "error")
OUTCOMES = ("success", "failed", "not_run")


def read_ledger(spark: SparkSession, path: str, header_type: str) -> tuple[dict, DataFrame]:
    """(header, rows) of JSON lines whose one header has ``record_type`` = ``header_type``; a file without header or rows is an error."""
    lines = spark.read.json(path)
    if "record_type" not in lines.columns:
        raise ValueError(f"{path}: no header")
    header = lines.where(F.col("record_type") == header_type).limit(2).collect()
    if len(header) != 1:
        raise ValueError(f"{path}: {len(header) or 'no'} header")
    rows = lines.where(~F.col("record_type").eqNullSafe(header_type))
    return header[0].asDict(), rows


def read_index(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(header, cases) of a suite index; an index without cases is an error."""
    header, rows = read_ledger(spark, path, "suite_header")
    if not rows.take(1):
        raise ValueError(f"{path}: no cases")
    return header, rows


def index_of(mutated: DataFrame, canonical: DataFrame) -> DataFrame:
    """The index of written mutations and the canonical cases, in order of their ids."""
    return mutated.withColumn("kind", F.lit("mutated")).unionByName(canonical.withColumn("kind", F.lit("canonical")), allowMissingColumns=True).orderBy("case_id")


def write_lines(rows: DataFrame, path: str, *order: str) -> None:
    """``rows`` as JSON lines in order, in as many files as Spark deals out; their digests are those of :func:`file_digests`."""
    rows.orderBy(*order).write.json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files in a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def differences(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """Keys of one side only, with ``side`` (``left`` or ``right``): no rows if both sets are equal."""
    a, b = left.select(*key).distinct(), right.select(*key).distinct()
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), list(key), "full_outer").where("_a is null or _b is null")
    return both.select(*key, F.when(F.col("_b").isNull(), "left").otherwise("right").alias("side"))


def bundle_problems(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, problem) of files (name, sha256) that are missing, unexpected or changed against ``expected`` (name, sha256)."""
    both = files.select("name", "sha256").join(expected.select("name", F.col("sha256").alias("want")), "name", "full_outer")
    problem = F.when(F.col("want").isNull(), "unexpected").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("want"), "changed")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def materialization_problems(ledger: DataFrame, index: DataFrame) -> DataFrame:
    """(case_id, problem): unknown statuses, repeated rows, and written cases that the index lacks, or has without their being written."""
    known = ledger.where(~F.col("status").isin(*STATUSES) | F.col("status").isNull()).select("case_id", F.lit("unknown_status").alias("problem"))
    again = ledger.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", F.lit("repeated").alias("problem"))
    apart = differences(ledger.where("status = 'written'"), index.where("kind = 'mutated'"), "case_id")
    return known.union(again).union(apart.select("case_id", F.when(F.col("side") == "left", "not_indexed").otherwise("not_written")))


def materialization_totals(ledger: DataFrame, index: DataFrame) -> DataFrame:
    """planned, written, selected, canonical_included in one row."""
    # each side is counted on its own, so that the order of an index is not made for a count; one row meets one row
    planned = ledger.agg(F.count("status").alias("planned"), F.count_if(F.col("status") == "written").alias("written"))
    return planned.crossJoin(index.agg(F.count("kind").alias("selected"), F.count_if(F.col("kind") == "canonical").alias("canonical_included")))


def check_header(header: dict, ledger: DataFrame) -> None:
    """Raises unless the header's totals are those of the rows."""
    counts = {r["status"]: r["n"] for r in ledger.groupBy("status").agg(F.count("*").alias("n")).collect()}  # a row for each status
    seen = {"planned": sum(counts.values())} | {s: counts.get(s, 0) for s in STATUSES}
    wrong = {k: (header.get(k), v) for k, v in seen.items() if header.get(k) != v}
    if wrong:
        raise ValueError(f"header and rows differ: {wrong}")


def failure_problems(failures: DataFrame, records: DataFrame, evaluators: DataFrame) -> DataFrame:
    """(evaluator_name, case_id, problem) of a failure ledger (case_id, evaluator_name, repeat_index, status, error_kind)."""
    key = ["evaluator_name", "case_id"]
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    row = (
        F.when(blank("evaluator_name") | blank("case_id") | (F.coalesce("repeat_index", F.lit(0)) < 0) | ~F.coalesce(F.col("status").isin("success", "failed"), F.lit(False)), "malformed")
        .when((F.col("status") == "failed") & blank("error_kind"), "no_error_kind")
    )
    own = failures.select(*key, row.alias("problem")).where("problem is not null")
    again = failures.groupBy(*key, F.coalesce("repeat_index", F.lit(0)).alias("r")).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit("duplicate").alias("problem"))
    foreign = failures.join(evaluators.select("evaluator_name").distinct(), "evaluator_name", "left_anti").select(*key, F.lit("unknown_evaluator").alias("problem"))
    both = failures.where("status = 'failed'").join(records.select(*key).distinct(), key, "left_semi").select(*key, F.lit("also_scored").alias("problem"))
    return own.union(again).union(foreign).union(both)


def outcome_problems(outcomes: DataFrame, cases: DataFrame, repeats: int) -> DataFrame:
    """(case_id, repeat_index, problem): slots that are missing, foreign, duplicate or malformed against cases times repeats."""
    key = ["case_id", "repeat_index"]
    planned = cases.select("case_id").distinct().select("case_id", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat_index"))
    seen = outcomes.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("status").isin(*OUTCOMES), F.lit(False))).alias("bad"))
    both = planned.withColumn("p", F.lit(True)).join(seen, key, "full_outer")
    kinds = F.array(
        F.when(F.col("n").isNull(), "missing"), F.when(F.col("p").isNull(), "foreign"), F.when(F.col("n") > 1, "duplicate"), F.when(F.col("bad") > 0, "malformed"),
    )
    return both.select(*key, F.explode(F.array_compact(kinds)).alias("problem"))


#: Evaluators whose slots are counted in one pass.
AT_ONCE = 4


def _accounts(told: DataFrame, names: list[str | None]) -> DataFrame:
    """:func:`accounting` of these evaluators: a row for each case with the counts of all of them, so that neither an evaluator's slots nor the index are grouped or joined on their own."""
    own = [F.col("evaluator_name").eqNullSafe(F.lit(name)) for name in names]
    counts = [F.count_if(is_own & (F.col("side") == side)).alias(f"{side}{i}") for i, is_own in enumerate(own) for side in ("s", "f")]
    cases = told.groupBy("case_id").agg(*counts, F.count_if(F.col("side") == "p").alias("p"))
    # a case without an id is none that an index has
    known = (F.col("p") > 0) & F.col("case_id").isNotNull()
    slot = lambda plan, name, s, f: F.struct(F.lit(plan).alias("plan"), F.lit(name).cast("string").alias("evaluator_name"), s.alias("s"), f.alias("f"))
    sides = [slot(True, None, F.col("p"), F.lit(0).cast("long")), *(slot(False, name, F.col(f"s{i}"), F.col(f"f{i}")) for i, name in enumerate(names))]
    slots = cases.select(known.alias("known"), F.explode(F.array(*sides)).alias("x")).select("known", "x.*").where("s > 0 or f > 0")
    s, f = F.col("s") > 0, F.col("f") > 0
    kinds = {"scored": s, "failed": f, "clashing": s & f, "foreign": ~F.col("known"), "repeated": (F.col("s") > 1) | (F.col("f") > 1), "met": F.col("known")}
    few = slots.groupBy("plan", "evaluator_name").agg(*(F.count_if(c).alias(k) for k, c in kinds.items()))
    # the planned cases and a row for each evaluator are side by side
    told = few.agg(F.coalesce(F.max(F.when(F.col("plan"), F.col("scored"))), F.lit(0).cast("long")).alias("planned"), F.collect_list(F.when(~F.col("plan"), F.struct("evaluator_name", *kinds))).alias("x"))
    return told.select("planned", F.inline("x"))


def accounting(records: DataFrame, failures: DataFrame, index: DataFrame, evaluators: Iterable[str | None] | None = None) -> DataFrame:
    """Per evaluator: planned, scored, failed, clashing (scored and failed), missing, foreign, repeated, and whether planned = scored + failed with nothing amiss.

    ``evaluators`` are all that records and failures name, if that is known; otherwise they are looked up first.
    """
    key = ["evaluator_name", "case_id"]
    rows = records.select(*key, F.lit("s").alias("side")).unionByName(failures.select(*key, F.lit("f").alias("side")))
    names = sorted({r["evaluator_name"] for r in rows.select("evaluator_name").distinct().collect()} if evaluators is None else set(evaluators), key=lambda x: (x is not None, x))
    out = None
    for k in range(0, max(len(names), 1), AT_ONCE):
        some = names[k:k + AT_ONCE] or [None]
        of = reduce(or_, (F.col("evaluator_name").eqNullSafe(F.lit(name)) for name in some))
        told = (rows if len(names) <= AT_ONCE else rows.where(of)).unionByName(index.select(F.lit(None).cast("string").alias("evaluator_name"), "case_id", F.lit("p").alias("side")))
        accounts = _accounts(told, some)
        out = accounts if out is None else out.unionByName(accounts)
    out = out.withColumn("missing", F.col("planned") - F.col("met"))
    clean = (F.col("clashing") + F.col("foreign") + F.col("repeated") + F.col("missing") == 0) & (F.col("planned") == F.col("scored") + F.col("failed"))
    return out.select("evaluator_name", "planned", "scored", "failed", "clashing", "missing", "foreign", "repeated", clean.alias("complete"))


def changed_metrics(stored: DataFrame, recomputed: DataFrame, key: str = "evaluator_name") -> DataFrame:
    """(key, metric, stored, recomputed) of stored values that differ from recomputed ones, nulls being equal."""
    names = [c for c in stored.columns if c != key]

    def long(df: DataFrame, value: str) -> DataFrame:
        cells = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(value)) for c in names))
        return df.select(key, F.explode(cells).alias("x")).select(key, "x.*")

    both = long(stored, "stored").join(long(recomputed, "recomputed"), [key, "metric"], "full_outer")
    return both.where(~F.col("stored").eqNullSafe(F.col("recomputed")))


def build_cases(index: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Cases of an index (case_id, kind, fixture_id) with the columns of their fixtures, in order of case_id; a case without a fixture is an error."""
    out = index.join(fixtures.withColumn("_known", F.lit(True)), "fixture_id", "left")
    require_none(out.where("_known is null").select("case_id", "fixture_id"), "no fixture for the case")
    return out.drop("_known").orderBy("case_id")


def split_outcomes(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of attempts with a nullable ``error_kind``."""
    failures = attempts.where("error_kind is not null").select("case_id", "evaluator_name", F.lit(0).alias("repeat_index"), F.lit("failed").alias("status"), "error_kind")
    return attempts.where("error_kind is null").drop("error_kind"), failures
