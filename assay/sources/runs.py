"""Run files: a header line and one JSON line per record; CSV and Markdown sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators.integrity import require_none
from assay.schema import RECORD

META = "run_id string, suite_name string, suite_hash string, base_seed long, evaluators array<string>, started_at string, git_commit string"


def read_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, records) of a run file; lines of an unknown type are an error."""
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", F.get_json_object("value", "$.record_type").alias("kind"))
    require_none(rows.where(~F.coalesce(F.col("kind").isin("run_metadata", "case"), F.lit(False))).select(F.substring("value", 1, 80)), "unknown record type")
    meta = rows.where("kind = 'run_metadata'").select(F.from_json("value", META, {"mode": "FAILFAST"}).alias("x")).select("x.*")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RECORD.fields if f.name not in ("repeat_index", "row_id"))
    cases = rows.where("kind = 'case'").select(F.from_json("value", fields, {"mode": "FAILFAST"}).alias("x"), F.get_json_object("value", "$.evaluation_metadata.repeat_index").cast("int").alias("r"))
    # an absent and a null repeat both read as 0
    return meta, cases.select("x.*", F.coalesce("r", F.lit(0)).alias("repeat_index"))


def write_run(records: DataFrame, header: dict, path: str, compression: str = "gzip") -> None:
    """Header and records as JSON lines in one directory, compressed, as most of a line is names of fields; the header sorts first."""
    spark = records.sparkSession
    spark.createDataFrame([(__import__("json").dumps({"record_type": "run_metadata", **header}, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path, compression=compression)
    meta = F.create_map(F.lit("repeat_index"), F.col("repeat_index")).alias("evaluation_metadata")
    columns = [c for c in records.columns if c not in ("repeat_index", "row_id")]
    records.select(F.to_json(F.struct(F.lit("case").alias("record_type"), *columns, meta)).alias("value")).write.mode("append").text(path, compression=compression)


def write_records_csv(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Nine fixed columns, a ``dim_`` column for every dimension that occurs, and confidence; correct as 0 or 1; compressed, as values repeat."""
    names = sorted(r[0] for r in records.select(F.explode(F.map_keys("dimensions"))).distinct().collect())
    fixed = ["case_id", "case_kind", "parent_id", "operator", "report_class", "expected_decision", "evaluator_name", "decision"]
    dims = [F.col("dimensions")[n].alias(f"dim_{n}") for n in names]
    records.select(*fixed, F.col("correct").cast("int").alias("correct"), *dims, "confidence").write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path, compression=compression)


def markdown_summary(bundle: DataFrame) -> str:
    """A short report from the one row per evaluator of a metric bundle; values are rounded here only."""
    out = ["# Results", ""]
    for row in bundle.orderBy("evaluator_name").collect():
        out += [f"## {row['evaluator_name']}", ""]
        out += [f"- {k.replace('_', ' ')}: " + ("n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for k, v in row.asDict().items() if k != "evaluator_name"]
        out.append("")
    return "\n".join(out)
