"""Markdown reports and model responses made from the driver tables, with what they must be read as, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.plans.bindings import read
from assay.schema import DIMENSIONS

_PLANTED = {7: "It matches the vendor advisory identifier.", 11: "This holds for every version ever released.", 13: "An emergency response is required.", 17: "The outcome is inconclusive.", 23: "The login contains no admin content."}


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_text): a report around every document; sections, steps and phrases depend on its id."""
    k = F.col("doc_id")

    def part(every: int, *lines: str):
        return F.when(k % every == 0, "".join(f"{x}\n" for x in lines)).otherwise("")

    body = F.regexp_replace(F.replace(F.lower(F.coalesce("text", F.lit(""))), F.lit("#"), F.lit(" ")), "[`~\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029\n]", "")
    steps = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.when(i <= k % 4, F.concat(i.cast("string"), F.lit(". do it\n"))).otherwise("")), "")
    raw = F.concat(
        F.lit("# Report "), k.cast("string"), F.lit("\n## Summary\nA bypass of the login.\n```\n# no heading\n```\n"), part(2, "## Affected Component", "server"), part(3, "## Affected versions", "1.0"),
        F.lit("## Preconditions\nnone\n## Steps to reproduce ##\n"), steps, F.lit("## Observed result\n"), body, F.lit("\n"), part(5, "## Expected security boundary", "No security boundary is given."),
        *(part(every, said) for every, said in _PLANTED.items()), part(19, "## References", "one"), part(29, "## Background information", "two"),
    )
    return read(spark, sf_dir, "documents").select("doc_id", raw.alias("raw_text"))


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports as structured cases (report_id)."""
    from assay.operators.evaluators import structured

    return structured(reports(spark, sf_dir).select(F.concat(F.lit("r"), "doc_id").alias("report_id"), "raw_text"))


_K = "doc_id % {} = 0"
_FOUND = [
    (f"doc_id % 2 <> 0", "MISSING_SECTION_AFFECTED_COMPONENT:medium"), ("doc_id % 3 <> 0", "MISSING_SECTION_AFFECTED_VERSIONS:medium"), ("doc_id % 5 <> 0", "MISSING_SECTION_EXPECTED_SECURITY_BOUNDARY:medium"),
    ("doc_id % 4 = 0", "EMPTY_REPRO_STEPS:high"), ("doc_id % 4 IN (1, 2)", "THIN_REPRO_STEPS:medium"), (_K.format(7), "FABRICATED_IDENTIFIER_CLAIM:high"), (_K.format(11), "SCOPE_EXPANSION_CLAIM:medium"),
    (_K.format(13), "IMPACT_INFLATION_LANGUAGE:medium"), (_K.format(5), "NO_SECURITY_BOUNDARY_STATED:high"), (_K.format(23), "CLAIM_EVIDENCE_CONFLICT:critical"), ("doc_id % 3 <> 0", "MISSING_AFFECTED_VERSIONS:low"),
    (_K.format(19), "UNVERIFIED_REFERENCE_BLOCK:low"), (_K.format(29), "TANGENTIAL_CONTENT_SECTION:info"), (_K.format(17), "SELF_DECLARED_UNCERTAINTY:medium"),
]
_STEP = "CASE doc_id % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 0.35 WHEN 2 THEN 0.65 ELSE 1.0 END"
SQL = f"""
WITH d AS (SELECT doc_id, CAST(doc_id % 2 <> 0 AS INTEGER) + CAST(doc_id % 3 <> 0 AS INTEGER) + CAST(doc_id % 5 <> 0 AS INTEGER) AS missing, CAST(doc_id % 7 = 0 AS INTEGER) AS fab, CAST(doc_id % 23 = 0 AS INTEGER) AS con,
  doc_id % 11 = 0 AS sco, CAST(doc_id % 13 = 0 AS INTEGER) AS inf, doc_id % 19 = 0 AS refs, CASE WHEN doc_id % 29 = 0 THEN 0.02 ELSE 0 END AS slack FROM documents),
x AS (SELECT *, CAST(1 - missing / 7 AS DOUBLE) AS share, greatest(0, 1 - 0.45 * fab - 0.55 * con - CASE WHEN con > 0 THEN 0.15 ELSE 0 END) AS cons FROM d),
y AS (SELECT *, least(1, share * 0.35 + ({_STEP}) * 0.65) AS repro, greatest(0, least(1, share * 0.7 + CASE WHEN fab = 0 THEN 1.0 ELSE 0.6 END * 0.3 - 0.05 * fab - CASE WHEN refs THEN 0.1 ELSE 0 END)) AS evid,
  greatest(0, 1 - 0.45 * inf - CASE WHEN doc_id % 5 = 0 AND inf > 0 THEN 0.2 ELSE 0 END) AS cal, greatest(0, least(1, 1 - CASE WHEN sco THEN 0.4 ELSE 0 END - CASE WHEN doc_id % 3 <> 0 THEN 0.25 ELSE 0 END)) AS scope FROM x),
z AS (SELECT *, (round(repro, 3) + round(evid, 3) + round(cons, 3) + round(cal, 3) + round(scope, 3)) / 5 AS overall FROM y),
r AS (SELECT doc_id, 'Report ' || doc_id AS title, CAST(5 + 3 - missing + CAST(doc_id % 19 = 0 AS INTEGER) + CAST(doc_id % 29 = 0 AS INTEGER) AS INTEGER) AS n_sections, CAST(doc_id % 4 AS INTEGER) AS steps, missing,
  array_to_string(list_filter([{", ".join(f"CASE WHEN {w} THEN '{c}' END" for w, c in _FOUND)}], lambda c: c IS NOT NULL), ' ') AS codes,
  CASE WHEN cons <= 0.45 OR doc_id % 5 = 0 OR con > 0 THEN 'reject' WHEN fab > 0 OR sco OR inf > 0 OR refs OR repro < 0.8 - slack OR evid < 0.8 - slack OR overall < 0.78 - slack OR doc_id % 17 = 0 THEN 'needs_manual_review' ELSE 'accept' END AS decision FROM z)
"""
SECTIONS = """,
part AS (SELECT doc_id, unnest([{'o': 0, 'h': 'Report ' || doc_id, 'l': 1, 'n': 1}, {'o': 1, 'h': 'Summary', 'l': 2, 'n': 5}, {'o': 2, 'h': 'Affected Component', 'l': 2, 'n': CASE WHEN doc_id % 2 = 0 THEN 2 END},
  {'o': 3, 'h': 'Affected versions', 'l': 2, 'n': CASE WHEN doc_id % 3 = 0 THEN 2 END}, {'o': 4, 'h': 'Preconditions', 'l': 2, 'n': 2}, {'o': 5, 'h': 'Steps to reproduce', 'l': 2, 'n': CAST(1 + doc_id % 4 AS INTEGER)},
  {'o': 6, 'h': 'Observed result', 'l': 2, 'n': 2 + CASE WHEN doc_id % 5 <> 0 THEN planted ELSE 0 END}, {'o': 7, 'h': 'Expected security boundary', 'l': 2, 'n': CASE WHEN doc_id % 5 = 0 THEN 2 + planted END},
  {'o': 8, 'h': 'References', 'l': 2, 'n': CASE WHEN doc_id % 19 = 0 THEN 2 END}, {'o': 9, 'h': 'Background information', 'l': 2, 'n': CASE WHEN doc_id % 29 = 0 THEN 2 END}]) AS s
  FROM (SELECT doc_id, CAST(doc_id % 7 = 0 AS INTEGER) + CAST(doc_id % 11 = 0 AS INTEGER) + CAST(doc_id % 13 = 0 AS INTEGER) + CAST(doc_id % 17 = 0 AS INTEGER) + CAST(doc_id % 23 = 0 AS INTEGER) AS planted FROM documents)),
sec AS (SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS ordinal, s.h AS heading, s.l AS level, CAST(sum(s.n) OVER w - s.n + 1 AS INTEGER) AS start_line, CAST(sum(s.n) OVER w AS INTEGER) AS end_line
  FROM part WHERE s.n IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY s.o))
"""

_BODY = r"translate(lower(coalesce(text, '')), '#`~' || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(133) || chr(8232) || chr(8233) || chr(10), ' ')"


def _raw(summary: str = "", preconditions: str = "", versions: str = "## Affected versions\n1.0\n", title: str = "") -> str:
    """SQL of a report's text, with more behind its title, summary and preconditions."""
    def part(every: int, said: str) -> str:
        return f"CASE WHEN doc_id % {every} = 0 THEN '{said}' ELSE '' END"

    steps = " || ".join(f"CASE WHEN doc_id % 4 >= {i} THEN '{i}. do it\n' ELSE '' END" for i in (1, 2, 3))
    parts = [
        f"'# Report ' || doc_id || '{title}\n## Summary\nA bypass of the login.\n```\n# no heading\n```{summary}\n'", part(2, "## Affected Component\nserver\n"), part(3, versions),
        f"'## Preconditions\nnone{preconditions}\n## Steps to reproduce ##\n'", steps, "'## Observed result\n'", _BODY, "'\n'", part(5, "## Expected security boundary\nNo security boundary is given.\n"),
        *(part(every, said + "\n") for every, said in _PLANTED.items()), part(19, "## References\none\n"), part(29, "## Background information\ntwo\n"),
    ]
    return " || ".join(parts)


def _less(sql: str) -> str:
    """``sql`` without its last line break."""
    return f"regexp_replace({sql}, '\\n$', '')"


def changed(preamble: str) -> str:
    """SQL of (doc_id, operator, text) of mutated reports, @ standing for a drawn sentence."""
    texts = {
        "remove_affected_version": f"CASE WHEN doc_id % 3 = 0 THEN {_less(_raw(versions=''))} ELSE {_raw()} END", "add_authorization_preamble": _raw(title=f"\n\n{preamble}"),
        "impossible_precondition": _less(_raw(preconditions="\n@")), "misattribute_cve": _less(_raw(summary="\n\n@")),
    }
    return " UNION ALL ".join(f"SELECT doc_id, '{o}' AS operator, md5({t}) AS digest FROM documents" for o, t in texts.items())


_CASES = (
    "fine", "fenced", "bare fence", "other fence", "words before", "not a number", "unknown key", "decision", "boolean", "too large", "dimension missing", "findings", "rationale", "blank", "declined", "prose", "list", "two documents",
)


def response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, response): a model's response for every turn, whose text is the rationale and whose length the confidence, good or with a fault that depends on its number."""
    k, text = F.col("k"), F.coalesce("text", F.lit(""))
    dims = ", ".join(f'"{d}": 0.5' for d in DIMENSIONS)
    confidence = ((F.length(text) % 101).cast("decimal(10,2)") / 100).cast("decimal(10,2)").cast("string")
    begun = F.concat(F.lit('{"decision": "reject", "confidence": '), confidence, F.lit(f', "dimensions": {{{dims}}}, "findings": [{{"code": "A_1"}}, {{"code": "bad code"}}, 3], '))
    good = F.concat(begun, F.expr("substring(to_json(struct(coalesce(text, '') as rationale)), 2)"))
    last = DIMENSIONS[-1]
    told = lambda value: F.regexp_replace(good, '"confidence": [0-9.]+', f'"confidence": {value}')
    made = [
        good, F.concat(F.lit(" ```json\n"), good, F.lit("\n``` ")), F.concat(F.lit("```JSON "), good, F.lit("```")), F.concat(F.lit("```python\n"), good, F.lit("\n```")), F.concat(F.lit("Sure: "), good),
        told("NaN"), F.replace(good, F.lit('"findings"'), F.lit('"finding"')), F.replace(good, F.lit('"reject"'), F.lit('"maybe"')),
        told("true"), told("1.5"), F.replace(good, F.lit(f'"{last}"'), F.lit('"other"')),
        F.regexp_replace(good, r"\[\{.*?, 3\]", '"none"'), F.concat(begun, F.lit('"rationale": 7}')), F.lit(" \n "), F.concat(F.lit("I'm sorry, but I can't help with "), F.translate(F.substring(text, 1, 400), "{", "x")), F.lit("No idea."), F.concat(F.lit("["), good, F.lit("]")), F.concat(good, good),
    ]
    out = made[0]
    for i, value in enumerate(made):
        out = F.when(k % len(made) == i, value).otherwise(out) if i else out
    rows = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), "text")
    return rows.select("k", out.alias("response"))


_FAILURES = (None, None, None, "parse.extra_text", "parse.extra_text", "parse.invalid_json", "parse.unknown_keys", "parse.invalid_decision", "parse.invalid_confidence", "parse.invalid_confidence",
             "parse.invalid_dimensions", "parse.invalid_findings", "parse.invalid_rationale", "parse.empty_response", "refusal.text_pattern", "parse.no_json_object", "parse.non_object", "parse.extra_text")
RESPONSES = f"""
WITH c AS (SELECT conv_id * 100 + turn AS k, coalesce(text, '') AS text FROM conversations),
f AS (SELECT *, CASE k % {len(_FAILURES)} {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_FAILURES) if x)} END AS failure FROM c),
r AS (SELECT k, failure, CASE WHEN failure IS NULL THEN 'reject' END AS decision, CASE WHEN failure IS NULL THEN (length(text) % 101) / CAST(100 AS DOUBLE) END AS confidence, CASE WHEN failure IS NULL THEN 1 END AS n_findings,
  CASE WHEN failure IS NULL THEN least(length(text), 1000) END AS rationale_chars, CASE WHEN failure IS NULL THEN md5(substr(text, 1, 1000)) END AS rationale_digest FROM f)
"""
