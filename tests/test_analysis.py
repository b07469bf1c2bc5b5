"""Published analyses: digests of tables, refusals, staged writing, verification."""

import json
import os

import pytest
from pyspark.sql import functions as F

from assay.operators import analysis as a

DDL = "case_id string, case_kind string, parent_id string, operator string, report_class string, expected_decision string, evaluator_name string, decision string, confidence double, correct boolean, dimensions map<string,double>, repeat_index int"


@pytest.fixture()
def tables(spark):
    rows = [(f"c{k}", "canonical", None, None, "valid", "accept", e, d, 0.5, d == "accept", {"b": 1.0, "a": 0.5}, 0) for k in range(6) for e, d in (("x", "accept" if k % 2 else "reject"), ("y", "accept")) if (k, e) != (5, "y")]
    records = spark.createDataFrame(rows, DDL)
    failures = spark.createDataFrame([("c5", "y", "failed", "timeout")], "case_id string, evaluator_name string, status string, error_kind string")
    return records, failures, records.select("case_id").distinct()


def digest(df):
    return tuple(a.table_digest(df).first())


def test_digests(spark):
    rows = spark.createDataFrame([(1, {"a": 1.0, "b": None}, [{"x": 1}]), (2, None, None), (2, None, None)], "k int, m map<string,double>, s array<map<string,int>>")
    own = digest(rows)
    assert own[0] == 3 and digest(rows.repartition(3).select("s", "k", "m")) == own
    assert digest(rows.withColumn("m", F.when(F.col("k") == 1, F.map_from_arrays(F.array(F.lit("b"), F.lit("a")), F.array(F.lit(None).cast("double"), F.lit(1.0)))))) == own
    others = [rows.dropDuplicates(["k"]), rows.union(rows.limit(1)), rows.withColumn("k", F.col("k") + 1), rows.withColumn("m", F.create_map(F.lit("a"), F.lit(1.0))), rows.withColumn("n", F.lit(None).cast("string")), rows.limit(0), rows.withColumnRenamed("k", "l")]
    assert len({own, *map(digest, others)}) == 1 + len(others)
    # equal rows do not cancel each other out
    assert digest(rows.where("k = 2")) != digest(rows.where("k = 2").union(rows.where("k = 2"))) != digest(rows.limit(0))


def test_round_trip(spark, tables, tmp_path):
    made = a.document(*tables)
    assert made["coverage"] == {"x": {"planned": 6, "scored": 6, "failed": 0, "not_run": 0}, "y": {"planned": 6, "scored": 5, "failed": 1, "not_run": 0}}
    (tmp_path / "analysis-v0").mkdir()
    place = a.publish(str(tmp_path), spark, made)
    assert a.verified(place, spark, *tables) == json.loads(json.dumps(made))
    # published again, it takes the place of the former one, and nothing is left beside it
    assert a.publish(str(tmp_path), spark, made) == place and [n for n in os.listdir(tmp_path)] == ["analysis-v1"]


def test_other_tables_are_refused(spark, tables, tmp_path):
    records, failures, index = tables
    place = a.publish(str(tmp_path), spark, a.document(*tables))
    other = records.withColumn("decision", F.when(F.col("case_id") == "c1", "reject").otherwise(F.col("decision")))
    cases = {
        "records.digest, metrics of x, metrics of y": (other, failures, index),
        "outcomes.present, outcomes.rows, outcomes.digest, coverage.failed of y, coverage.not_run of y": (records, None, index),
        "records.rows, records.digest, outcomes.amiss of x": (records.union(records.where("evaluator_name = 'x'").limit(1)), failures, index),
        "outcomes.digest, outcomes.status": (records, failures.withColumn("status", F.lit("odd")), index),
        "coverage.planned of x, coverage.not_run of x, coverage.planned of y, coverage.not_run of y": (records, failures, index.union(spark.range(1).select(F.lit("c9")))),
    }
    for message, found in cases.items():
        with pytest.raises(a.AnalysisError, match=message):
            a.verified(place, spark, *found)


def test_changed_metrics_and_versions_are_refused(spark, tables, tmp_path):
    made = a.document(*tables)
    for change, message in (({"metrics": {**made["metrics"], "x": {**made["metrics"]["x"], "decision_accuracy": 1.0}}}, "metrics of x"), ({"version": 2}, "compute it again"), ({"schema": 0}, "compute it again"), ({"evaluators": ["y", "x"]}, "sorted")):
        place = a.publish(str(tmp_path / message.replace(" ", "-")), spark, made | change)
        with pytest.raises(a.AnalysisError, match=message):
            a.verified(place, spark, *tables)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "part.txt").write_text("{")
    with pytest.raises(a.AnalysisError, match="no analysis"):
        a.read(str(tmp_path / "other"), spark)


def test_work_that_does_not_add_up_is_not_published(spark, tables):
    records, failures, index = tables
    good = {"x": {"planned": 6, "scored": 6, "failed": 0, "not_run": 0}, "y": {"planned": 6, "scored": 5, "failed": 1, "not_run": 0}}
    assert a.document(*tables, given=good)["coverage"] == good
    for bad in (good | {"x": good["x"] | {"scored": 5}}, good | {"x": {"planned": 6}}, good | {"x": good["x"] | {"planned": "6"}}, {"x": good["x"]}, good | {"z": good["x"]}):
        with pytest.raises(a.AnalysisError):
            a.document(*tables, given=bad)
    both = failures.union(spark.createDataFrame([("c1", "x", "failed", "timeout")], failures.schema))
    for found in ((records, both, index), (records.union(records), failures, index), (records, failures, index.where("case_id <> 'c3'"))):
        with pytest.raises(a.AnalysisError):
            a.document(*found)
    # an open plan can be published, but not verified as complete
    assert a.document(records, None, index)["coverage"]["y"]["not_run"] == 1


def test_maps_are_sorted_without_lambdas(spark):
    rows = spark.createDataFrame([(1, {"b": 2.0, "a": 1.0})], "k int, m map<string,double>")
    plan = rows.select(a.row_digest(rows).alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "array_sort" not in plan
    nested = spark.createDataFrame([(1, {"b": {"y": 2, "x": 1}, "a": None})], "k int, m map<string,map<string,int>>")
    turned = nested.withColumn("m", F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(None).cast("map<string,int>"), F.map_from_arrays(F.array(F.lit("x"), F.lit("y")), F.array(F.lit(1), F.lit(2))))))
    assert digest(nested) == digest(turned)


def test_tables_are_measured_once_for_several_indexes(spark, tables, monkeypatch):
    made, own = json.loads(json.dumps(a.document(*tables))), a.measured(*tables[:2])
    more = tables[2].union(spark.range(1).select(F.lit("c9")))
    wanted = a.problems(made, *tables[:2], more)
    assert ("coverage.planned", "x") in wanted
    monkeypatch.setattr(a, "table_digest", lambda *_: pytest.fail("a table is read again"))
    assert a.problems(made, *tables, own=own) == [] and a.problems(made, *tables[:2], more, own=own) == wanted
