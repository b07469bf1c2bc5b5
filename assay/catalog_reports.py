"""Queries of reports, responses and safety over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import identity, safety, text
from assay.operators import evaluators, integrity, mutations, responses
from assay.plans import bindings as b
from assay.plans import reports as rb
from assay.plans.sql import REC
from assay.registry import query
from assay.sources import runs


@query(rb.SQL + """SELECT doc_id, title, n_sections, steps, missing FROM r""")
def report_structure(spark, sf_dir):
    rows = evaluators.structured(rb.reports(spark, sf_dir), "doc_id")
    missing = sum(((~evaluators.present(k)).cast("int") for k in evaluators.SECTION_PATTERNS), F.lit(0))
    return rows.select("doc_id", "title", F.size("sections").alias("n_sections"), evaluators.step_count().alias("steps"), missing.alias("missing"))


@query(rb.SQL + rb.SECTIONS + "SELECT * FROM sec")
def report_sections(spark, sf_dir):
    rows = text.sections(rb.reports(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "ordinal", "heading", "level", "start_line", "end_line")


@query(rb.SQL + "SELECT doc_id, codes FROM r")
def rules_findings(spark, sf_dir):
    rows = evaluators.RULES.apply(rb.named(spark, sf_dir), findings=True)
    return rows.select(F.substring("report_id", 2, 20).cast("long").alias("doc_id"), F.array_join(F.transform("findings", lambda f: F.concat(f.code, F.lit(":"), f.severity)), " ").alias("codes"))


@query(rb.SQL + "SELECT doc_id, decision FROM r")
def rules_decisions(spark, sf_dir):
    rows = evaluators.RULES.apply(rb.named(spark, sf_dir))
    return rows.select(F.substring("report_id", 2, 20).cast("long").alias("doc_id"), "decision")


@query(rb.RESPONSES + "SELECT k, failure, decision, confidence, n_findings, rationale_chars, rationale_digest FROM r")
def read_responses(spark, sf_dir):
    rows = responses.with_results(rb.response_rows(spark, sf_dir), "response")
    return rows.select("k", "failure", "decision", "confidence", F.when(F.col("failure").isNull(), F.size("findings")).alias("n_findings"), F.length("rationale").cast("long").alias("rationale_chars"), F.md5("rationale").alias("rationale_digest"))


#: How a turn's text is brought in, and whether that declines.
_OPENINGS = (("I must decline. ", True), ("I\'m sorry, but I cannot help with ", True), ("They say I cannot help with ", False), ("I cannot help {", False), ("Sorry, I am unable to assist: ", True), ("i can\'t do that, ", True), ("Here it is: ", False))
_OPENED = " ".join("WHEN {} THEN {}".format(i, f"length(text) <= {500 - len(x)}" if declines else "false") for i, (x, declines) in enumerate(_OPENINGS))


@query(f"SELECT conv_id, turn, CASE length(coalesce(text, '')) % {len(_OPENINGS)} {_OPENED} END AS refusal FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)")
def refusals(spark, sf_dir):
    """Every turn's text behind an opening that declines or does not; its length decides which, and whether the whole is short enough."""
    text = F.coalesce("text", F.lit(""))
    opening = F.element_at(F.array(*(F.lit(x) for x, _ in _OPENINGS)), (F.length(text) % len(_OPENINGS) + 1).cast("int"))
    said = F.concat(opening, F.translate(text, "{ \t\n\r", "xxxxx"))
    return b.read(spark, sf_dir, "conversations").select("conv_id", "turn", responses.is_refusal(said).alias("refusal"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'json_syntax' WHEN event_id % 5 = 1 THEN 'schema' WHEN event_id % 5 = 2 THEN 'rate_limit' WHEN event_id % 5 = 3 THEN 'unknown' ELSE 'http_permanent' END AS class FROM events""")
def failure_classes(spark, sf_dir):
    k = F.col("event_id") % 5
    kind = F.when(k <= 1, "parse").when(k == 2, "rate-limit").when(k == 3, "parse").otherwise("http-permanent")
    detail = F.when(k == 0, "parse.extra_text").when(k == 1, "parse.unknown_keys").when(k == 3, "parse.new").otherwise("x")
    return b.read(spark, sf_dir, "events").select("event_id", responses.failure_class(kind, detail).alias("class"))


@query(r"""SELECT page_id, list_sort(list_filter(list_distinct([rtrim(url, '.,;!?"*_~'), 'https://host' || (page_id % 9) || '.test/a(b', 'http://user x@evil' || page_id || '.example.net.test/q']), lambda u: NOT regexp_matches(lower(regexp_extract(u, '^[a-z]+://([^/:?#]+)', 1)), '^localhost$|\.(localhost|local)$|(^|\.)example\.(com|org|net|edu)$'))) AS urls
FROM (SELECT page_id, url FROM pages)""".replace("'https://host' || (page_id % 9) || '.test/a(b'", "'https://host' || (page_id % 9) || '.test/a'"))
def unsafe_urls(spark, sf_dir):
    """Addresses of pages in prose, with reserved ones, quotes, brackets and user information around them."""
    k = F.col("page_id").cast("string")
    prose = F.concat(
        F.lit("See "), "url", F.lit(" and (http://localhost:80/x), [http://[::1]/y]. Also \"https://host"), (F.col("page_id") % 9).cast("string"), F.lit(".test/a(b\" or <http://a.b.example.com>! Not http://user x@evil"), k, F.lit(".example.net.test/q."),
    )
    return b.read(spark, sf_dir, "pages").select("page_id", safety.unsafe_urls(prose).alias("urls"))


@query(r"""WITH t AS (SELECT doc_id, coalesce(text, '') || ' CVE-20' || lpad(CAST(length(coalesce(text, '')) % 100 AS VARCHAR), 2, '0') || '-12345 and CVE-2099-1111 at http://h' || (length(coalesce(text, '')) % 5) || '.test, or http://x.example.org/ ' || reverse(coalesce(text, '')) AS said FROM documents)
SELECT doc_id, list_concat(list_transform(list_sort(list_distinct(list_filter(regexp_extract_all(said, '(?i)CVE-[0-9]{4}-[0-9]{4,}'), lambda x: substr(x, 5, 4) <> '2099'))), lambda x: 'real_year_cve ' || x),
  list_transform(list_sort(list_distinct(list_filter(regexp_extract_all(said, '(?i)https?://[^\s,<>()]+'), lambda x: NOT contains(x, '.example.org')))), lambda x: 'unsafe_url ' || x)) AS found FROM t""")
def content_violations(spark, sf_dir):
    """Every text, forwards and backwards, with an identifier and two addresses in between."""
    text = F.coalesce("text", F.lit(""))
    told = F.concat(
        text, F.lit(" CVE-20"), F.lpad((F.length(text) % 100).cast("string"), 2, "0"), F.lit("-12345 and CVE-2099-1111 at http://h"), (F.length(text) % 5).cast("string"), F.lit(".test, or http://x.example.org/ "), F.reverse(text),
    )
    return b.read(spark, sf_dir, "documents").select("doc_id", F.transform(safety.violations(told), lambda v: F.concat(v.rule, F.lit(" "), v.found)).alias("found"))


@query(rb.changed(mutations.PREAMBLE))
def mutated_reports(spark, sf_dir):
    """Four rewrites of every report; drawn sentences are shown as @."""
    rows = rb.reports(spark, sf_dir)
    operators = ("remove_affected_version", "add_authorization_preamble", "impossible_precondition", "misattribute_cve")
    plan = rows.select(
        F.col("doc_id").cast("string").alias("case_id"), F.lit("f").alias("fixture_id"), F.explode(F.array(*map(F.lit, operators))).alias("operator"), F.col("doc_id").cast("decimal(20,0)").alias("seed"), "raw_text",
    )
    out = mutations.applied(plan)
    told = F.col("text")
    for sentence in mutations.PRECONDITIONS:
        told = F.replace(told, F.lit(sentence), F.lit("@"))
    for template in mutations.ATTRIBUTIONS:
        before, after = template.split("{cve}")
        told = F.regexp_replace(told, f"\\Q{before}\\ECVE-2099-[0-9]{{4}}\\Q{after}\\E", "@")
    return out.select(F.col("case_id").cast("long").alias("doc_id"), "operator", F.md5(told).alias("digest"))


_REPORT = """sha256('{"domain":"demo","text":' || to_json(coalesce(text, '')) || ',"type":"report","version":1}')"""
_TARGET = """sha256('{"domain":"demo","expected_decision":' || CASE WHEN doc_id % 2 = 0 THEN '"accept"' ELSE 'null' END || ',"expected_dimensions":{"a":0.5,"b":0.25},"type":"target","version":1}')"""


@query(f"""SELECT doc_id, {_REPORT} AS report_hash, {_TARGET} AS target_hash, sha256('{{"domain":"demo","report_hash":"' || {_REPORT} || '","target_hash":"' || {_TARGET} || '","type":"input","version":1}}') AS input_hash FROM documents""")
def input_identities(spark, sf_dir):
    rows = b.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("doc_id") % 2 == 0, "accept").alias("d"))
    dims = F.create_map(F.lit("b"), F.lit(0.25), F.lit("a"), F.lit(0.5)).cast("map<string,double>")
    rows = rows.select("doc_id", identity.report_hash(F.col("text"), "demo").alias("report_hash"), identity.target_hash(F.col("d"), dims, "demo").alias("target_hash"))
    return rows.withColumn("input_hash", identity.input_hash(F.col("report_hash"), F.col("target_hash"), "demo"))


@query(REC + """SELECT evaluator_name, case_kind, count(*) AS n, count(parent_id) AS parents, count(*) FILTER (ok) AS correct, count(expected_decision) AS scored, CAST(sum(tenths) AS BIGINT) AS tenths, CAST(sum(a0) AS BIGINT) AS first_dimension FROM rec GROUP BY ALL""")
def run_round_trip(spark, sf_dir):
    """Records written as a run file and read back."""
    path = b.scratch(spark, "run")
    runs.write_run(b.records(spark, sf_dir), {"run_id": "r", "suite_name": "s", "base_seed": 7, "evaluators": ["alpha", "beta"]}, path)
    _, rows = runs.read_run(spark, path)
    tenths = lambda c: F.sum(F.round(c * 10).cast("long"))
    return rows.groupBy("evaluator_name", "case_kind").agg(
        F.count("*").alias("n"), F.count("parent_id").alias("parents"), F.count_if("correct").alias("correct"), F.count("expected_decision").alias("scored"), tenths(F.col("confidence")).alias("tenths"),
        tenths(F.element_at("dimensions", "reproducibility")).alias("first_dimension"),
    )


@query(REC + """SELECT evaluator_name, coalesce(operator, '') AS operator, count(*) AS n, count(*) FILTER (ok) AS correct, CAST(sum(tenths) AS BIGINT) AS tenths FROM rec GROUP BY ALL""")
def csv_round_trip(spark, sf_dir):
    """Records written as CSV and read back."""
    path = b.scratch(spark, "csv")
    runs.write_records_csv(b.records(spark, sf_dir), path)
    rows = spark.read.option("header", True).csv(path)
    return rows.groupBy("evaluator_name", F.coalesce("operator", F.lit("")).alias("operator")).agg(
        F.count("*").alias("n"), F.count_if(F.col("correct") == "1").alias("correct"), F.sum(F.round(F.col("confidence").cast("double") * 10).cast("long")).alias("tenths"),
    )


@query("""WITH i AS (SELECT doc_id, unnest([
CASE WHEN doc_id % 6 = 0 THEN 'error|unknown evidence: odd' END, CASE WHEN doc_id % 2 <> 0 THEN 'error|no section for affected_component' END, CASE WHEN doc_id % 3 <> 0 THEN 'error|no section for affected_versions' END,
CASE WHEN doc_id % 5 = 0 AND doc_id % 8 <> 0 THEN 'warning|valid but not reproducible' END]) AS x FROM documents)
SELECT 'r' || doc_id AS report_id, split_part(x, '|', 1) AS severity, split_part(x, '|', 2) AS issue FROM i WHERE x IS NOT NULL""")
def canonical_issues(spark, sf_dir):
    k = F.substring("report_id", 2, 20).cast("long")
    needed = F.array_compact(F.array(F.lit("summary"), F.lit("affected_component"), F.lit("affected_versions"), F.when(k % 6 == 0, "odd")))
    cases = rb.named(spark, sf_dir).withColumns({"required_evidence": needed, "report_class": F.when(k % 5 == 0, "valid").otherwise("invalid"), "reproducible": k % 8 == 0})
    return integrity.canonical_issues(cases)


@query("""SELECT 'r' || doc_id AS report_id, x AS issue FROM (SELECT doc_id, unnest([CASE WHEN doc_id % 4 = 0 THEN 'parent is not canonical' END, CASE WHEN doc_id % 9 = 0 THEN 'unsafe_url: http://evil.test/x' END]) AS x FROM documents) WHERE x IS NOT NULL""")
def derived_issues(spark, sf_dir):
    k = F.col("doc_id")
    rows = rb.reports(spark, sf_dir).select(
        F.concat(F.lit("r"), k).alias("report_id"), F.when(k % 4 == 0, "other-1").otherwise("canonical-1").alias("parent_id"), F.concat("raw_text", F.when(k % 9 == 0, " http://evil.test/x ").otherwise("")).alias("raw_text"),
    )
    return integrity.derived_issues(rows)
