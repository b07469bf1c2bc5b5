"""Figures of large tables: steps that must not be made twice or run where they find nothing."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assay import catalog_outcomes, catalog_panels, storage
from assay.functions import denials, identity, safety, text
from assay.operators import analysis, evaluators, integrity, ledgers, resample, spans
from assay.plans import bindings, rounds
from assay.sources import corpus, runs

SMALL = "/root/testdata/sf0.001"


def test_a_pattern_runs_only_where_its_literal_is():
    """Whatever a pattern matches contains its literal, in the lower case of the report."""
    every = (*evaluators.FABRICATION, *evaluators.SCOPE_EXPANSION, *evaluators.INFLATION, *evaluators.NO_BOUNDARY, *evaluators.UNCERTAINTY, *evaluators.CONTRADICTION, *evaluators.ATTRIBUTION)
    assert all(len(evaluators.needle(p)) >= 6 for p in every)
    assert evaluators.needle(r"cannot (?:be |)(?:determined|explained)") == "cannot " and evaluators.needle(r"identical `?location`?") == "identical "
    assert evaluators.needle(r"lists as CVE-.*x") == "lists as cve-"


def test_letters_that_match_without_regard_to_case(spark):
    rows = spark.createDataFrame([("UNREſOLVED",), ("İnconclusıve",), ("unre solved",), (None,)], "raw_text string").withColumn("low", text.lowered(F.col("raw_text")))
    got = rows.select(evaluators.hits(("unresolved", "inconclusive")).alias("n"), sum(F.col("raw_text").rlike(f"(?iu){p}").cast("int") for p in ("unresolved", "inconclusive")).alias("m")).collect()
    assert [r["n"] for r in got] == [r["m"] for r in got] == [1, 1, 0, None]


@pytest.mark.parametrize("said", ["no boundary is crossed if the user_if is an admin, and it's so.", "a if no boundarý is crossed", "we foo_bar w - w no boundary is crossed, based entirely on it"])
def test_other_words_become_one_letter_each(spark, said):
    """The marks of a text are those that it has without the shorter form."""
    row = spark.createDataFrame([(said,)], "t string")
    found = ("no boundary is crossed",)
    short = denials.marks(F.col("t"), found)
    steps, denials.SHORT_STEPS = denials.SHORT_STEPS, ()
    try:
        whole = denials.marks(F.col("t"), found)
    finally:
        denials.SHORT_STEPS = steps
    got = row.select(short.alias("a"), whole.alias("b")).first()
    assert got["a"] == got["b"]


def test_report_hashes_are_made_without_python(spark):
    """any character is escaped as canonical JSON escapes it, and no text goes to Python."""
    texts = ["", *map(chr, range(0x00, 0x82)), "\\u001f \\\\\" \x1f\x0b\n", "é ſ   \U0001F600", "a\tb\\n"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", identity.report_hash(F.col("t"), "démo\"").alias("h"))
    assert "Python" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert all(r["h"] == (None if r["t"] is None else identity.tagged_digest("report", {"text": r["t"]}, "démo\"")) for r in rows.collect())


def test_addresses_behind_a_long_text(spark):
    """what Python sees begins with the first address, whatever stands before it."""
    said = ["\U0001F600é\n\r x@y [ " * 9 + "ht\ntp://h.test/a and https://b@c d.test", "http://a.test", "no address", "see HTTPS://x.test/q.", None]
    got = [r["u"] for r in spark.createDataFrame([(t,) for t in said], "t string").select(safety.unsafe_urls(F.col("t")).alias("u")).collect()]
    want = [sorted({t for t, a in safety.url_tokens(x) if t and safety._is_unsafe(t, a)}) if x else [] for x in said]
    assert got == want and got[0]


def test_totals_of_an_ordered_index_need_no_sort(spark):
    """an index comes in order of its ids, which a count does not need."""
    ledger = spark.createDataFrame([("a", "written"), ("b", "error"), ("c", None)], "case_id string, status string")
    index = ledgers.index_of(ledger.where("status = 'written'").select("case_id"), spark.createDataFrame([("x",), ("y",)], "case_id string"))
    totals = ledgers.materialization_totals(ledger, index)
    assert "Sort" not in totals._jdf.queryExecution().optimizedPlan().toString()
    assert totals.first().asDict() == {"planned": 2, "written": 1, "selected": 3, "canonical_included": 2}


def test_csv_files_are_compressed(spark, tmp_path):
    """a record's CSV is mostly repeated values."""
    rows = spark.createDataFrame([("c", "canonical", None, None, "valid", "accept", "e", "accept", True, {"a": 0.5}, 0.5)] * 3, "case_id string, case_kind string, parent_id string, operator string, report_class string, expected_decision string, evaluator_name string, decision string, correct boolean, dimensions map<string,double>, confidence double")
    runs.write_records_csv(rows, str(tmp_path / "out"))
    files = [f.name for f in (tmp_path / "out").iterdir() if f.name.startswith("part-")]
    assert files and all(f.endswith(".csv.gz") for f in files)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).where("correct = '1' and dim_a = '0.5'").count() == 3


def test_sums_of_halves_give_the_digest_of_whole_parts(spark):
    """parts of digests are added as longs, and the digest stays what it was."""
    rows = spark.range(50).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
    hashed = [r[0] for r in rows.select(analysis.row_digest(rows)).collect()]
    parts = [sum(int(h[16 * k : 16 * k + 16], 16) for h in hashed) % (1 << 64) for k in range(4)]
    want = hashlib.sha256(":".join(map(str, [50, *parts])).encode()).hexdigest()
    got = analysis.table_digest(rows)
    assert got.first()["digest"] == want
    types = [f.dataType.simpleString() for f in rows.select(*analysis.digest_halves(F.col("t")).values()).schema.fields]
    assert types == ["bigint"] * 8


def test_many_clusters_make_larger_blocks_not_more(spark, monkeypatch):
    """the shares of blocks that reach the driver do not grow with the clusters."""
    monkeypatch.setattr(resample, "BLOCK", 5)
    monkeypatch.setattr(resample, "BLOCKS", 3)
    rows = spark.range(100).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("evaluator_name"), F.col("id").cast("string").alias("cluster"), (F.col("id") % 2).alias("correct"), F.lit(1).cast("long").alias("cases"))
    seen = []
    draw = spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: seen.append(x) or draw(x))
    sums = resample._sums(rows, 20, 0).collect()
    assert len(seen[0]) == 3 and len(sums) == 40 and all(r["cases"] == 100 for r in sums)


def test_sections_are_made_once_for_their_rows(spark):
    """no filter is inferred that makes all sections of a text again."""
    reports = spark.createDataFrame([(1, "# A\nx\n"), (2, ""), (3, None)], "doc_id long, raw_text string")
    for rows in (text.sections(reports), spans.captured(reports)):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
        assert [(r["doc_id"], r["ordinal"], r["text"]) for r in rows.collect()] == [(1, 0, "# A\nx")]


def test_lines_of_any_line_break(spark):
    """searches for single line breaks give the lines that a class of them gives."""
    said = ["", "\n", "a", "a\n", "\n\na\n\n", *(f"{c}a{c}{c}b\r\n\n{c}" for c in text.ODD_BREAKS), "é‧‪\n", None]
    got = spark.createDataFrame([(t,) for t in said], "t string").select(text.lines(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == [None if t is None else t.splitlines() for t in said]
    told = spark.createDataFrame([(t,) for t in said if t not in (None, "\n")], "t string").select("t", F.transform(text.flagged_lines(F.col("t")), lambda y: y.line).alias("x")).collect()
    assert all(r["x"] == r["t"].splitlines() for r in told)


def _dealt(df, keys: str) -> str:
    """How many partitions an optimised plan deals rows out into by ``keys``."""
    return re.search(rf"RepartitionByExpression \[{keys}#\d+L?\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString()).group(1)


def test_violations_come_from_one_scan(spark, monkeypatch):
    """each row and key that breaks a rule, as often as it does, in tasks that grow with no table."""
    monkeypatch.setattr(integrity, "PART", 3)
    monkeypatch.setattr(storage, "PER_TASK", 10)
    schema = "case_id string, case_kind string, parent_id string, operator string, evaluator_name string, repeat_index int, decision string, expected_decision string, correct boolean"
    one = ("a", "mutated", None, "o", "e", 0, "accept", "accept", False)
    rows = spark.createDataFrame([*[one] * 10, ("b", "mutated", "p", None, "e", 0, "accept", "reject", False), ("c", "canonical", None, None, "e", 0, "accept", None, None), (None, None, None, None, "e", 1, None, None, False)], schema)
    want = Counter({("duplicate_key", "a|e|0"): 1, ("correct_flag", "a|e|0"): 10, ("missing_link", "a|e|0"): 10, ("missing_link", "b|e|0"): 1, ("correct_flag", "c|e|0"): 1})
    for found in (integrity.violations(rows), integrity.violations(rows, 100)):
        assert Counter((r["rule"], r["key"]) for r in found.collect()) == want
        assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert _dealt(found, "case_id") == "11"


def test_rows_of_a_task_do_not_grow(spark, monkeypatch):
    """Line items are dealt out by card or order into as many parts as they need."""
    monkeypatch.setattr(storage, "PER_TASK", 100)
    lines = bindings.read(spark, SMALL, "lineitem").count()
    votes, reference = catalog_panels._cards(spark, SMALL)
    assert _dealt(votes, "card_id") == str(1 + lines // 100)
    assert _dealt(bindings.records(spark, SMALL), "l_orderkey") == str(1 + lines // 100)
    assert _dealt(catalog_panels.preserving_inventory(spark, SMALL), "case_id") == str(1 + bindings.most_records(spark, SMALL) // 100)


def test_manifests_are_parsed_once_in_many_tasks(spark, monkeypatch):
    """a manifest is read once, by as many tasks as their number needs; a report is seen if no index hides it, wherever its manifest lies."""
    monkeypatch.setattr(corpus, "PARSED", 1)
    said = "id: {}\nreport:\n  path: {}\n"
    rows = [(f"/r/{k}/manifest.yaml", said.format(k, path)) for k, path in (("a", "a/x.md"), ("b", "h/x.md"), ("c", "c/x.md"), ("d", "d/x.md"), ("h", "a/x.md"), ("h/low", "a/x.md"))]
    rows += [("/r/a/mutation-manifest.yaml", said.format("other", "c/x.md")), ("/r/h/suite-index.jsonl", "{}"), ("/r/a/x.md", "t\n# A"), ("/r/h/x.md", "# H"), ("/r/c/x.md", "```\n# C\n```\n## D"), ("/r/d/x.md", "#\t\n")]
    found = corpus.fixtures(spark.createDataFrame(rows, "path string, content string"), "/r")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1 and int(_dealt(found, "folder")) == 8
    got = {r["id"]: (r["kind"], r["path"], r["raw_text"], r["problem"]) for r in found.collect()}
    assert got == {
        "a": ("canonical", "/r/a/x.md", "t\n# A", None), "b": ("canonical", "/r/h/x.md", None, "there is no such report"),
        "c": ("canonical", "/r/c/x.md", "```\n# C\n```\n## D", "the report has no first-level heading"), "d": ("canonical", "/r/d/x.md", "#\t\n", None),
    }


def test_rounds_need_no_digests_of_slots(spark, monkeypatch):
    """what is written of a plan is what the rounds are checked on, and line items move once."""
    monkeypatch.setattr(storage, "PER_TASK", 100)
    _, plan, _ = catalog_outcomes._rounds(spark, SMALL, of_plan=("slot", "round"))
    assert plan.columns == ["slot", "round"] and plan.exceptAll(catalog_outcomes._rounds(spark, SMALL)[1].select("slot", "round")).count() == 0
    ledger = rounds.ledger(spark, SMALL)
    assert _dealt(ledger, "l_orderkey") == str(1 + bindings.read(spark, SMALL, "lineitem").count() // 100)
    assert ledger._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
