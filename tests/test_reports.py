import random
import re
import time

import pytest
from pyspark.sql import functions as F

from assay.functions import safety, text
from assay.operators import evaluators, planning
from assay.sources import reports as source

GOOD = """# Sample gateway skips a check

## Summary

Any member can read records of another tenant, a disclosure of private data.

## Affected Component

`Gateway.read()` in the sample module.

## Affected Versions

Sample 1.0 to 1.2.

## Preconditions

- An account with the lowest privilege on tenant A.

## Reproduction Steps

1. Register two tenants on a local instance.
2. Upload a private document as tenant B.
3. Request the document as tenant A.

## Observed Result

The endpoint answers with the whole document of tenant B.

## Expected Security Boundary

Reads must stay within the tenant of the caller.
"""


@pytest.fixture()
def report(spark):
    def build(*texts):
        rows = spark.createDataFrame([(f"r{k}", f"r{k}", t) for k, t in enumerate(texts)], "report_id string, case_id string, raw_text string")
        return evaluators.structured(rows)

    return build


def sections(df):
    return {r["report_id"]: [(s["heading"], s["level"], s["start_line"], s["end_line"], s["text"]) for s in r["sections"]] for r in df.collect()}


def test_sections_and_fences(report):
    got = sections(report("intro\n\n# One #\nbody\n\n```\n# not\n~~~\n``\n```\n## Two\n~~~~\n# no\n~~~\n", "", "\n\n", "# \n#x\n####### seven\n"))
    assert got["r0"] == [(None, 0, 1, 2, "intro"), ("One", 1, 3, 10, "# One #\nbody\n\n```\n# not\n~~~\n``\n```"), ("Two", 2, 11, 14, "## Two\n~~~~\n# no\n~~~")]
    assert got["r1"] == got["r2"] == []
    assert [s[:2] for s in got["r3"]] == [("", 1)]


def test_titles(report):
    assert [r["title"] for r in report(GOOD, "no heading").orderBy("report_id").collect()] == ["Sample gateway skips a check", "r1"]


def test_evaluators(report):
    cases = report(
        GOOD, GOOD.replace("Reads must", "There is no security boundary here. Reads must"), GOOD.replace("Reads must", "If the plugin is off, no security boundary applies. Reads must"),
        GOOD.replace("2. Upload a private document as tenant B.\n3. Request the document as tenant A.\n", ""), GOOD + "\nThe cause is undetermined.\n", "",
    )
    out = {(r["evaluator_name"], r["case_id"]): r for r in evaluators.run(cases, [evaluators.RULES, evaluators.GRAPH, evaluators.TEXT_QUALITY, *evaluators.CONSTANT]).collect()}
    rules = [out["rules-baseline", f"r{k}"]["decision"] for k in range(6)]
    assert rules == ["accept", "reject", "needs_manual_review", "needs_manual_review", "needs_manual_review", "needs_manual_review"]
    graph = [out["evidence-graph-baseline", f"r{k}"]["decision"] for k in range(5)]
    assert graph == ["accept", "reject", "reject", "needs_manual_review", "needs_manual_review"]
    assert out["text-quality-baseline", "r0"]["dimensions"]["evidence_completeness"] == 1.0
    assert {r["decision"] for (name, _), r in out.items() if name == "always-reject"} == {"reject"}
    for r in out.values():
        assert all(0 <= v <= 1 for v in r["dimensions"].values()) and 0.05 <= r["confidence"] <= 0.99


def test_labels_are_hidden(report):
    cases = report(GOOD).withColumn("expected_decision", F.lit("reject")).withColumn("expected_dimensions", F.create_map(F.lit("reproducibility"), F.lit(0.25)))
    spy = evaluators.Evaluator("spy", (), lambda: F.struct(F.col("expected_decision").alias("decision")))
    with pytest.raises(Exception):
        evaluators.run(cases, [spy]).collect()
    (o,) = evaluators.run(cases, [evaluators.ORACLE]).collect()
    assert o["decision"] == "reject" and o["dimensions"]["reproducibility"] == 0.25 and o["dimensions"]["scope_consistency"] == 0.5


def test_cosine(report):
    (r,) = evaluators.cosine_of_sections(report(GOOD.replace("The endpoint answers with the whole document of tenant B.", "Any member can read records of another tenant, a disclosure of private data."))).collect()
    assert abs(r["cosine"] - 1) < 1e-12
    assert evaluators.cosine_of_sections(report("# T\n\n## Summary\n\nwords here\n")).count() == 0


def test_lines_and_steps(spark):
    df = spark.createDataFrame([("a\r\nb\x0bc\u2028d\n\n",), ("",)], "t string")
    assert [r[0] for r in df.select(text.lines(F.col("t"))).collect()] == [["a", "b", "c", "d", ""], []]
    df = spark.createDataFrame([("1. a\n 2) b\nx 3. c\n4.d",)], "t string")
    assert df.select(F.size(text.numbered_steps(F.col("t")))).first()[0] == 2


def test_safety(spark):
    hosts = ["localhost", "a.localhost", "x.local", "example.org", "deep.example.com", "notexample.com", "example.io", "10.0.0.1", "8.8.8.8", "[::1]", None]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert [r[0] for r in df.select(safety.is_reserved_host(F.col("h"))).collect()] == [True, True, True, True, True, False, False, True, False, True, False]
    (r,) = spark.createDataFrame([("CVE-2099-1001 CVE-2024-1234 CVE-2021-99999 CVE-2024-1234",)], "t string").select(safety.real_year_cves(F.col("t"))).collect()
    assert r[0] == ["CVE-2021-99999", "CVE-2024-1234"]


def test_planning(spark):
    fixtures = spark.createDataFrame([(f"f{k}", f"s{k}", "pair" if k == 3 else None, "valid") for k in range(4)], "fixture_id string, short_name string, pair_id string, report_class string")
    policies = spark.createDataFrame([("valid", 2, ["a_b", "c"]), ("pair", 1, ["z"])], "policy string, variants int, operators array<string>")
    plan = planning.rotation(planning.with_policy(fixtures, policies), policies)
    got = {(r["fixture_id"], r["variant"]): (r["operator"], r["case_id"]) for r in planning.with_seeds(plan, 1).collect()}
    assert got["f0", 0] == ("a_b", "mut-s0-a-b-01") and got["f0", 1] == ("c", "mut-s0-c-02") and got["f1", 0][0] == "c" and got["f3", 0][0] == "z" and len(got) == 7
    with pytest.raises(ValueError):
        planning.with_policy(fixtures.withColumn("report_class", F.lit("other")), policies)
    base = spark.createDataFrame([({"a": 0.9, "b": 0.2},)], "m map<string,double>")
    assert base.select(planning.dimension_deltas(F.col("m"), {"a": 0.3, "c": -0.6})).first()[0] == {"a": 1.0, "b": 0.2, "c": 0.0}


def test_status_machine(spark):
    rows = [("a", 1, None, None, "new", "old", False), ("a", 2, None, None, "new", "old", False), ("b", 1, "boom", None, None, "old", False), ("c", 1, None, "note", "x", "old", False), ("d", 1, None, None, "old", "old", False), ("e", 1, None, None, "new", "old", True)]
    df = spark.createDataFrame(rows, "case_id string, ordinal int, error string, note string, text string, parent_text string, unsafe boolean")
    got = [(r["case_id"], r["status"]) for r in planning.materialization_status(df).orderBy("case_id", "ordinal").collect()]
    assert got == [("a", "written"), ("a", "duplicate"), ("b", "error"), ("c", "no_op"), ("d", "no_op"), ("e", "safety_blocked")]


def test_manifests_and_reports_from_files(spark, tmp_path):
    pytest.importorskip("yaml")
    folder = tmp_path / "canonical" / "sample-001"
    folder.mkdir(parents=True)
    (folder / "report.md").write_text(GOOD)
    (folder / "manifest.yaml").write_text("id: canonical-sample-001\ntitle: Another title\nreport_class: valid\nseed: 17868228476706046877\nground_truth:\n  reproducible: true\n  required_evidence: [summary]\n  expected_dimensions: {reproducibility: 1}\nreport: {path: report.md}\n")
    (r,) = source.reports(spark, str(tmp_path)).collect()
    assert r["report_id"] == "canonical-sample-001" and int(r["seed"]) == 17868228476706046877 and r["expected_dimensions"] == {"reproducibility": 1.0}
    found = evaluators.structured(source.reports(spark, str(tmp_path)).withColumnRenamed("title", "manifest_title"))
    assert [p["problem"] for p in source.fixture_problems(found).collect()] == ["title does not match the first heading"]


def test_run_files(spark, tmp_path):
    from assay.sources import runs
    from assay.schema import RECORD

    row = ("c", "canonical", None, None, "valid", "accept", {"reproducibility": 0.5}, None, "a", "1", "accept", 0.75, {"reproducibility": 0.5}, True, [], "why", 2, 0)
    df = spark.createDataFrame([row], RECORD)
    runs.write_run(df, {"run_id": "r1", "suite_name": "s"}, str(tmp_path / "run"))
    meta, back = runs.read_run(spark, str(tmp_path / "run"))
    assert meta.first()["run_id"] == "r1" and back.first()["repeat_index"] == 2 and back.first()["confidence"] == 0.75
    runs.write_records_csv(df, str(tmp_path / "csv"))
    (c,) = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert c["dim_reproducibility"] == "0.5" and c["correct"] == "1" and c["parent_id"] is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"record_type": "odd"}\n')
    with pytest.raises(ValueError):
        runs.read_run(spark, str(tmp_path / "bad"))


def test_run_files_take_little_room(spark, tmp_path):
    """Lines of 2,000 records take a tenth of their size, and all come back."""
    from assay.sources import runs
    from assay.schema import RECORD

    rows = [(f"c{k}", "canonical", None, None, "valid", "accept", {"reproducibility": 0.5}, None, "a", "1", "accept", 0.75, {"reproducibility": 0.5}, True, [], "why", 2, 0) for k in range(2000)]
    runs.write_run(spark.createDataFrame(rows, RECORD), {"run_id": "r1"}, str(tmp_path / "run"))
    lines = spark.read.text(str(tmp_path / "run"))
    assert 10 * sum(p.stat().st_size for p in (tmp_path / "run").glob("part-*")) < lines.selectExpr("sum(length(value) + 1)").first()[0]
    meta, back = runs.read_run(spark, str(tmp_path / "run"))
    assert meta.count() == 1 and {r["case_id"] for r in back.collect()} == {r[0] for r in rows}


def plain_sections(raw):
    """Sections by reading line after line: (heading, level, first line, last line, text)."""
    lines = raw.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    out, fence = [], None
    for k, line in enumerate(lines, 1):
        mark = re.match(r"\s*(`{3,}|~{3,})(\s*$)?", line)
        head = None
        if fence is None and mark:
            fence = mark[1]
        elif fence is not None:
            if mark and mark[2] is not None and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                fence = None
        else:
            head = re.match(r"(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line)
        if head or not out:
            out.append([head and (head[2] or "").strip(), len(head[1]) if head else 0, k, k, []])
        out[-1][3] = k
        out[-1][4].append(line)
    return [(h, level, a, z, "\n".join(text).strip("\n")) for h, level, a, z, text in out if h is not None or "".join(text).strip()]


def test_sections_equal_a_plain_reading(spark):
    rng = random.Random(8)
    parts = ["# One", "## Two ##", "text", "", "```", "````", "~~~", "~~~~ py", "```python", "  ```", "``` x", "#no", "### ", "   ", "\t~~~", "# A\r", "1. x", "``"]
    texts = [rng.choice(["\n", "\r\n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 14))) + rng.choice(["", "\n", "\n\n"]) for _ in range(800)] + ["", "\n", "```\n"]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(9999, None)], "doc_id long, raw_text string")
    got = {r["doc_id"]: [(s["heading"], s["level"], s["start_line"], s["end_line"], s["text"]) for s in r["sections"]] for r in text.with_sections(rows).collect()}
    assert got == {k: plain_sections(t) for k, t in enumerate(texts)} | {9999: []}
    assert "Exchange" not in text.sections(rows)._jdf.queryExecution().executedPlan().toString()


def test_sections_cost_grows_with_length(spark):
    def seconds(n, unit):
        rows, began = spark.createDataFrame([(1, (unit * n)[:n])], "doc_id long, raw_text string"), time.perf_counter()
        text.sections(rows).count()
        return time.perf_counter() - began

    for unit in ("# h\n", "```\nx\n```\n", "text\n"):
        seconds(1000, unit)
        assert seconds(200_000, unit) < 40 * max(seconds(10_000, unit), 0.3)


def test_ranks_over_ranges(spark, monkeypatch):
    """Groups larger than a range, ties of the order's first column, null groups, and rows in many ranges."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(40), k) for k in range(500)]
    want = {}
    for g in ("a", "b", None):
        want |= {k: i for i, (_, _, k) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]))}
    df = spark.createDataFrame(rows, "g string, x int, k int")
    for most in (7, 100_000):
        monkeypatch.setattr(planning, "PER_RANGE", most)
        assert {r["k"]: r["place"] for r in planning.ranked(df, ["x", "k"], "g").collect()} == want
        assert [r["k"] for r in planning.ranked(df, ["k"]).orderBy("place").collect()] == list(range(500))
    assert planning.ranked(df.limit(0), ["k"], "g").count() == 0
    assert sorted(r[0] for r in planning.case_slice(df.select(F.format_string("c%03d", "k").alias("case_id")), 120, 5).collect()) == [f"c{k}" for k in range(120, 125)]
