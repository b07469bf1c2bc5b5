import datetime
import json

from pyspark.sql import functions as F

from assay.functions import identity
from assay.operators import responses as r
from assay.schema import DIMENSIONS
from assay.streaming import tallies

GOOD = {"decision": "reject", "confidence": 0.5, "dimensions": {d: 0.25 for d in DIMENSIONS}, "findings": [{"code": "A_1", "severity": "odd", "evidence": "e" * 300}, {"code": "bad code"}, 3], "rationale": "x" * 2000}


def test_strict_reading(spark):
    def bad(**change):
        return json.dumps({**GOOD, **change})

    cases = [
        (json.dumps(GOOD), None), ("```json\n" + json.dumps(GOOD) + "\n```", None), ("", "parse.empty_response"), ("no idea", "parse.no_json_object"),
        ("I'm sorry, but I cannot help with that.", "refusal.text_pattern"), ("Sure: " + json.dumps(GOOD), "parse.extra_text"), ("{broken", "parse.invalid_json"), ("[1]", "parse.non_object"),
        (bad(more=1), "parse.unknown_keys"), (bad(decision="maybe"), "parse.invalid_decision"), (bad(confidence=True), "parse.invalid_confidence"), (bad(confidence=1.5), "parse.invalid_confidence"),
        (bad(dimensions={}), "parse.invalid_dimensions"), (bad(findings={}), "parse.invalid_findings"), (bad(rationale=1), "parse.invalid_rationale"),
        (json.dumps(GOOD).replace("0.5", "NaN", 1), "parse.extra_text"), (None, "parse.empty_response"),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "id int, response string")
    got = {x["id"]: x for x in r.with_results(df).collect()}
    for k, (_, failure) in enumerate(cases):
        assert got[k]["failure"] == (failure if k != 15 else got[k]["failure"]) and (got[k]["decision"] is None) == (got[k]["failure"] is not None), k
    assert got[15]["failure"] in ("parse.invalid_json", "parse.extra_text")
    f = got[0]["findings"]
    assert [(x["code"], x["severity"], len(x["evidence"])) for x in f] == [("A_1", "medium", 200)] and len(got[0]["rationale"]) == 1000


def test_refusals_and_classes(spark):
    df = spark.createDataFrame([("I must decline.",), ("Sorry, I can't assist with this",), ("I cannot help {",), ("They said I cannot help",), ("I cannot help " + "x" * 500,)], "t string")
    assert [x[0] for x in df.select(r.is_refusal(F.col("t"))).collect()] == [True, True, False, False, False]
    df = spark.createDataFrame([("parse", "parse.extra_text"), ("parse", "parse.non_object"), ("parse", "odd"), ("rate-limit", "rate_limited"), ("new", "x")], "k string, d string")
    assert [x[0] for x in df.select(r.failure_class(F.col("k"), F.col("d"))).collect()] == ["json_syntax", "schema", "unknown", "rate_limit", "unknown"]


def test_identities(spark):
    assert identity.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'.encode()
    df = spark.createDataFrame([("t", None, {"a": 0.5}), ("t", "null", {}), (None, None, None)], "t string, e string, d map<string,double>")
    rows = df.select(identity.report_hash(F.col("t"), "x").alias("r"), identity.target_hash(F.col("e"), F.col("d"), "x").alias("h")).collect()
    assert rows[0]["r"] == rows[1]["r"] and rows[2]["r"] is None and len({x["h"] for x in rows}) == 3


def test_windowed_accuracy(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1, 10, 0)
    rows = [("a", "accept", "accept", at), ("a", "accept", "reject", at + datetime.timedelta(minutes=3)), ("a", None, "reject", at + datetime.timedelta(minutes=11))]
    schema = "evaluator_name string, expected_decision string, decision string, decided_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = tallies.windowed_accuracy(stream).writeStream.outputMode("complete").format("memory").queryName("tallies").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((x["total_cases"], x["correct_cases"], x["decision_accuracy"]) for x in spark.table("tallies").collect())
    assert got == [(0, 0, 0.0), (2, 1, 0.5)]
