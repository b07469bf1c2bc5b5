"""Ledgers, bundles and panels: files, headers and errors (rows are compared with SQL through the registered queries)."""

import json

import pytest
from pyspark.sql import functions as F

from assay.operators import ledgers, panels, planning


def test_ledger_files(spark, tmp_path):
    rows = [("a", "written"), ("b", "no_op"), ("c", "written")]
    header = {"record_type": "materialization_header", "planned": 3, "written": 2, "no_op": 1, "duplicate": 0, "safety_blocked": 0, "error": 0}
    lines = [header, *({"record_type": "materialization_outcome", "case_id": c, "status": s} for c, s in rows)]
    (tmp_path / "ledger.jsonl").write_text("\n".join(map(json.dumps, lines)))
    found, ledger = ledgers.read_ledger(spark, str(tmp_path / "ledger.jsonl"), "materialization_header")
    assert ledger.count() == 3
    ledgers.check_header(found, ledger)
    with pytest.raises(ValueError):
        ledgers.check_header(found | {"written": 3}, ledger)
    (tmp_path / "bare.jsonl").write_text(json.dumps({"case_id": "a"}))
    for name in ("suite_header", "materialization_header"):
        with pytest.raises(ValueError):
            ledgers.read_ledger(spark, str(tmp_path / "bare.jsonl"), name)
    (tmp_path / "index.jsonl").write_text(json.dumps({"record_type": "suite_header"}))
    with pytest.raises(ValueError):
        ledgers.read_index(spark, str(tmp_path / "index.jsonl"))


def test_written_lines_and_bundles(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "case_id string, k int")
    ledgers.write_lines(rows, str(tmp_path / "out"), "case_id")
    assert [r["case_id"] for r in spark.read.json(str(tmp_path / "out")).collect()] == ["a", "b", "c"]
    files = ledgers.file_digests(spark, str(tmp_path / "out")).where("name like 'part%'")
    assert ledgers.bundle_problems(files, files).count() == 0
    other = files.withColumn("sha256", F.lit("x")).union(spark.createDataFrame([("more", 1, "y")], "name string, bytes long, sha256 string"))
    assert {r["problem"] for r in ledgers.bundle_problems(files, other).collect()} == {"changed", "missing"}


def test_cases_without_fixtures_and_changed_metrics(spark):
    index = spark.createDataFrame([("a", "f1"), ("b", "f2")], "case_id string, fixture_id string")
    with pytest.raises(ValueError):
        ledgers.build_cases(index, spark.createDataFrame([("f1", 1)], "fixture_id string, x int")).count()
    stored = spark.createDataFrame([("e", 0.5, None), ("g", 1.0, 2.0)], "evaluator_name string, a double, b double")
    again = spark.createDataFrame([("e", 0.5, None), ("g", 1.0, 2.5)], "evaluator_name string, a double, b double")
    assert [(r["evaluator_name"], r["metric"]) for r in ledgers.changed_metrics(stored, again).collect()] == [("g", "b")]
    done, failed = ledgers.split_outcomes(spark.createDataFrame([("a", "e", None), ("b", "e", "timeout")], "case_id string, evaluator_name string, error_kind string"))
    assert done.count() == 1 and failed.first()["error_kind"] == "timeout"


def test_equal_texts_slices_and_eligibility(spark):
    children = spark.createDataFrame([("c1", "p", "x"), ("c2", "p", "y")], "case_id string, parent_id string, text string")
    pairs = panels.text_pairs(children, spark.createDataFrame([("p", "x")], "case_id string, text string"))
    assert [r[0] for r in panels.equal_pairs(pairs).collect()] == ["c1"]
    cases = spark.createDataFrame([(f"c{k}",) for k in range(5)], "case_id string")
    assert sorted(r[0] for r in planning.case_slice(cases, 3, 9).collect()) == ["c3", "c4"]
    with pytest.raises(ValueError):
        planning.case_slice(cases, 5, 1)
    specs = spark.createDataFrame([("a", "x", True, False), ("b", "y", False, True)], "operator string, category string, degrading boolean, presentation boolean")
    assert [(r["detection_eligible"], r["susceptibility_eligible"]) for r in planning.eligibility(specs).orderBy("operator").collect()] == [(True, False), (False, True)]
