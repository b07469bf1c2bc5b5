"""Supplements of ledgers, discovery of fixtures, spans and cards: refusals and edges (rows are compared with SQL through the registered queries)."""

import pytest
from pyspark.sql import functions as F

from assay.operators import cards, spans, supplements
from assay.sources import corpus

LEDGER = "slot string, round int, attempt int, status string, note string"


@pytest.fixture()
def ledger(spark):
    rows = [("a", 0, 1, "http_error", ""), ("a", 0, 2, "http_error", ""), ("b", 0, 1, "success", ""), ("c", 0, 1, "invalid_or_transport_error", "x"), ("a", 1, 3, "http_error", ""), ("a", 1, 4, "success", ""), ("c", 2, 2, "http_error", "")]
    return spark.createDataFrame(rows, LEDGER)


@pytest.fixture()
def planned(ledger):
    before = lambda k, slot: supplements.slot_digests(ledger.where(F.col("round") < k)).where(F.col("slot") == slot).select("slot", F.lit(k).alias("round"), F.col("attempts").alias("previous_attempts"), F.col("digest").alias("prior_digest"))
    plan = before(1, "a").union(before(2, "c"))
    protocols = supplements.round_digests(ledger).where("round > 0").select("round", F.col("digest").alias("prior_digest"), F.lit(3).cast("long").alias("max_requests"))
    return plan, protocols


def problems(ledger, plan):
    return sorted(map(tuple, supplements.slot_problems(ledger, plan).collect()))


def test_rounds_that_fit(ledger, planned):
    whole, limits = supplements.merged(ledger, *planned)
    assert whole.count() == 7 and {r["slot"]: r["limit"] for r in limits.collect()} == {"a": 5, "c": 4}
    # the order of rows and columns says nothing
    again = ledger.select("note", "status", "attempt", "round", "slot").repartition(5)
    assert problems(again, planned[0]) == [] and supplements.round_problems(again, *planned).count() == 0


def test_changed_pasts_are_found(spark, ledger, planned):
    plan, protocols = planned
    row = lambda *r: spark.createDataFrame([r], LEDGER)
    for changed, want in (
        (ledger.withColumn("note", F.when((F.col("slot") == "c") & (F.col("round") == 0), "y").otherwise(F.col("note"))), [("c", 2, "changed_history")]),
        (ledger.withColumn("status", F.when((F.col("slot") == "a") & (F.col("attempt") == 2), "success").otherwise(F.col("status"))), [("a", 1, "after_success"), ("a", 1, "after_success"), ("a", 1, "changed_history")]),
        (ledger.union(row("b", 1, 2, "http_error", "")), [("b", 1, "after_success"), ("b", 1, "unplanned")]),
        (ledger.union(row("d", 2, 1, "http_error", "")), [("d", 2, "unplanned")]),
        (ledger.union(row("c", 2, 2, "http_error", "")), [("c", 2, "attempt")]),
        (ledger.union(row("c", 2, 4, "odd", "")), [("c", 2, "attempt"), ("c", 2, "status")]),
        (ledger.union(row("c", 2, None, None, "")), [("c", 2, "attempt"), ("c", 2, "attempt"), ("c", 2, "status")]),
        (ledger.union(spark.createDataFrame([("c", 2, k, "http_error", "") for k in (3, 4, 5)], LEDGER)), [("c", 2, "over_cap")]),
    ):
        assert problems(changed, plan) == want
        with pytest.raises(ValueError):
            supplements.merged(changed, plan, protocols)


def test_plans_and_protocols(spark, ledger, planned):
    plan, protocols = planned
    other = spark.createDataFrame([("z", 1, 0, None)], plan.schema)
    assert problems(ledger, plan.union(other)) == [("z", 1, "unknown_slot")] and problems(ledger, plan.union(plan.where("slot = 'a'"))) == [("a", 1, "repeated_plan")]
    assert problems(ledger, plan.withColumn("previous_attempts", F.lit(1).cast("long"))) == [("a", 1, "changed_history")]
    found = lambda p, q=ledger: sorted(map(tuple, supplements.round_problems(q, plan, p).collect()))
    assert found(protocols.where("round = 1")) == [(2, "no_protocol")] and found(protocols.withColumn("max_requests", F.lit(1).cast("long"))) == [(1, "request_cap"), (1, "too_many_requests"), (2, "request_cap")]
    assert found(protocols.withColumn("prior_digest", F.lit("x"))) == [(1, "prior_rows"), (2, "prior_rows")]
    # a round that has not run yet is bound to everything before it
    assert found(protocols, ledger.where("round < 2")) == []
    assert problems(ledger.limit(0), plan.limit(0)) == [] and supplements.round_problems(ledger.limit(0), plan.limit(0), protocols.limit(0)).count() == 0


def put(root, path, text):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text)


def test_discovery_of_files(spark, tmp_path):
    good = "# One\ntext\n"
    put(tmp_path, "a/b/manifest.yaml", "id: b\nreport: {path: a/b/report.md}\n")
    put(tmp_path, "a/b/report.md", good)
    put(tmp_path, "a/c/mutation-manifest.yaml", "id: c\nreport: {path: a/../a/./c/other.md}\n")
    put(tmp_path, "a/c/other.md", "```\n# no\n```\n\n# Two\n")
    put(tmp_path, "a/a/manifest.yaml", "id: a\nreport: {path: a/b/report.md}\n")
    put(tmp_path, "a/a/mutation-manifest.yaml", "id: other\nreport: {path: a/b/report.md}\n")
    # in, below and beside folders with an index
    put(tmp_path, "out/suite-index.jsonl", "{}")
    put(tmp_path, "out/x/y/manifest.yaml", "id: hidden\nreport: {path: /etc/report.md}\n")
    put(tmp_path, "out/manifest.yaml", "id: hidden too\n")
    put(tmp_path, "out2/z/manifest.yaml", "id: z\nreport: {path: a/b/report.md}\n")
    canonical, derived = corpus.discover(spark, str(tmp_path))
    assert [(r["id"], r["raw_text"]) for r in canonical.collect()] == [("a", good), ("b", good), ("z", good)] and [r["id"] for r in derived.collect()] == ["c"]
    for path, problem in (("../b/report.md", "outside"), ("/a/b/report.md", "outside"), ("a/../../x.md", "outside"), ("a/b", "no such"), ("", "outside"), ("a/b/none.md", "no such"), ("a/d/report.md", "heading")):
        put(tmp_path, "a/d/manifest.yaml", f"id: d\nreport: {{path: '{path}'}}\n")
        put(tmp_path, "a/d/report.md", "```\n# no\n```\n## Second\n")
        with pytest.raises(ValueError, match=problem):
            corpus.discover(spark, str(tmp_path))


def test_paths(spark):
    cases = {"x/y.md": "/r/s/x/y.md", "./x//y.md": "/r/s/x/y.md", "x/../y.md": "/r/s/y.md", "../s/y.md": "/r/s/y.md", "../y.md": None, "../../../../r/s/y": "/r/s/y", "/r/s/z": "/r/s/z", "/r/sz": None, "..": None, "../s": None, "": None, ".": None}
    rows = spark.createDataFrame(list(cases.items()), "p string, want string")
    assert {r["p"]: r["got"] for r in rows.select("p", corpus.resolved("/r/s/", F.col("p")).alias("got")).collect()} == cases
    empty = spark.createDataFrame([], "path string, content string")
    assert corpus.fixtures(empty, "/r").count() == 0


def test_spans(spark):
    reports = spark.createDataFrame([(1, "before\n# One ##\na\n\n\n## Two\n```\n# no\n```\n"), (2, "# Only"), (3, None), (4, "")], "doc_id long, raw_text string")
    taken = spans.captured(reports)
    assert spans.authorised(taken, reports).count() == 4
    assert {r["fault"] for r in spans.checked(taken, reports.where("doc_id <> 2")).collect()} == {None, "foreign"}
    edited = reports.withColumn("raw_text", F.replace("raw_text", F.lit("Two"), F.lit("2")))
    assert {(r["doc_id"], r["fault"]) for r in spans.checked(taken, edited).collect()} == {(1, "stale"), (2, None)}
    one = taken.where("heading = 'One'")
    for column, value, fault in (("start_line", 0, "outside"), ("end_line", 99, "outside"), ("end_line", 1, "outside"), ("end_line", 3, None), ("end_line", 2, "other_text"), ("text", "x", "other_text"), ("level", 2, "other_heading"), ("heading", "one", "other_heading"), ("heading", None, "other_heading"), ("identity", None, "stale")):
        changed = one.withColumn(column, F.lit(value).cast(dict(one.dtypes)[column]))
        assert [r["fault"] for r in spans.checked(changed, reports).collect()] == [fault], (column, value)
    with pytest.raises(ValueError, match="stale"):
        spans.authorised(taken, edited)
    assert spans.checked(taken.limit(0), reports).count() == 0


def test_cards_keep_their_answers(spark):
    ddl = "card_id string, schema_version string, expected_action string, input struct<opaque_id:string,context:map<string,struct<a:int,status:string>>,report:string,artifacts:array<array<struct<x:int,answer:string>>>,claims:array<struct<claim_id:string,status:string,deep:struct<rationale:string>>>,extra:string>"
    row = ("c", "1", "secret-0", ("o", {"k": (1, "secret-1")}, "r", [[(1, "secret-2")], None], [("q", "secret-3", ("secret-4",))], "secret-5"))
    table = spark.createDataFrame([row, ("d", "1", None, ("o", None, None, None, None, None))], ddl)
    shown = cards.views(table)
    assert cards.answer_fields(table.schema) == ["expected_action", "input.context{}.status", "input.artifacts[][].answer", "input.claims[].status", "input.claims[].deep.rationale"] and cards.answer_fields(shown.schema) == []
    got = {r["card_id"]: r["view"] for r in cards.serialized(shown).collect()}
    assert "secret" not in got["c"] and '"claim_id":"q"' in got["c"] and '"x":1' in got["c"] and '"claims":null' in got["d"]
    assert "secret" not in str(cards.without_answers(table.drop("input")).collect())
    for bad in (table.withColumn("card_id", F.lit(" ")), table.withColumn("input", F.col("input").dropFields("claims"))):
        with pytest.raises(ValueError):
            cards.views(bad)
