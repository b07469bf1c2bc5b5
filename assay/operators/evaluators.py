"""Evaluators of Markdown reports: report columns in, one decision struct out.

``structured`` turns a table of reports (report_id, raw_text) into one row per report
with its sections as an array; evaluators are column expressions over that row, so
Catalyst fuses them into one projection.  Labels are not among the columns that an
evaluator sees unless it declares that it needs them.

Dimension values are not rounded here; sinks round.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import denials as D
from assay.functions import text as T
from assay.functions.hashing import opaque_handle
from assay.schema import ACCEPT, DECISIONS, DIMENSIONS, REJECT, REVIEW

# Heading patterns of the core sections, and phrases that the rules look for.
SECTION_PATTERNS = {
    "summary": r"summary|description|overview",
    "affected_component": r"affected\s+components?",
    "affected_versions": r"affected\s+versions?",
    "preconditions": r"preconditions?",
    "reproduction_steps": r"reproduction\s+steps?|steps\s+to\s+reproduce",
    "observed_result": r"observed\s+results?",
    "expected_security_boundary": r"expected\s+security\s+boundar(?:y|ies)",
}
FABRICATION = (
    r"assigns? this issue advisory",
    r"matches the vendor advisory identifier",
    r"according to the deployment manifest used during testing",
    r"referenced in the component changelog",
)
SCOPE_EXPANSION = (
    r"every version ever released",
    r"all earlier releases since \d+\.\d+\.\d+ and all future releases",
    r"including builds distributed through unofficial mirrors",
    r"also present in the administrative api",
    r"including batch jobs and internal tooling",
)
INFLATION = (
    r"actively exploited data breach",
    r"fully compromise the entire platform",
    r"confirmed mass scanning in the wild",
    r"exposes every customer record",
    r"emergency response is required",
)
NO_BOUNDARY = (
    r"no security boundary",
    r"does not identify one",
    r"no boundary [^.?!]{0,2000}crossed",
    r"identifies none",
    r"intended behavior",
    r"product preference",
    r"hardening (?:opportunity|suggestion)",
    r"cosmetic observation",
    r"usability tradeoff rather than a remediation",
)
UNCERTAINTY = (
    r"manual review requested",
    r"maintainer (?:confirmation|input|assistance|reproduction|ruling) requested",
    r"happy to coordinate",
    r"undetermined",
    r"inconclusive",
    r"unresolved",
    r"withheld pending",
    r"cannot (?:be |)(?:determined|established|confirmed|explained|classified)",
    r"could not (?:be )?(?:determined|conclusively determine)",
    r"unclear whether",
    r"severity cannot be (?:set|determined)",
    r"evidence is insufficient",
    r"insufficient to distinguish",
    r"genuinely unknown",
    r"hinges on undocumented",
)
CONTRADICTION = (
    r"no bypass was demonstrated",
    r"both observed responses show",
    r"contradict",
    r"identical `?location`?",
    r"contain(?:s|ed)? no admin content",
    r"returned 403 forbidden and no cross-tenant data",
    r"could not reproduce any anomalous response",
    r"boundary held in every configuration",
)
ATTRIBUTION = (
    r"vendor has confirmed this issue as CVE-",
    r"previously disclosed and tracked as CVE-",
    r"tracking lists this defect as CVE-.*with fix status confirmed",
    r"fix status confirmed",
)
STRONG_CLAIM = r"bypass|compromise|exposes|breach|takeover|disclosure"
SEVERITY_WORDS = r"\b(?:critical|high|medium|low|severe|moderate|minor)\b"
CONSEQUENCE_WORDS = (
    r"\b(?:disclosure|bypass\w*|injection|takeover|exposure|compromise\w*|tamper\w*|escalation|denial|unauthorized|unauthenticated|"
    r"forg\w*|leak\w*|reveal\w*|allow\w*|accept\w*|skip\w*|persist\w*|execut\w*)\b"
)
GRAPH_NO_BOUNDARY = r"\b(?:no security boundary|does not identify one|identifies none|no boundary[^.]*crossed|intended behavior|product preference)\b"
GRAPH_HEDGED = r"\b(?:undetermined|unclear whether|cannot be determined|manual review requested)\b"
GRAPH_UNDERMINES = r"\b(?:however|could not reproduce|contradict\w*|behaved identically|boundary held|no \w+ was returned|returned 403)\b"


def structured(reports: DataFrame, key: str = "report_id", text_col: str = "raw_text") -> DataFrame:
    """``reports`` with ``sections``, in order, and ``title`` (first level-1 heading, else the key)."""
    out = T.with_sections(reports, text_col)
    top = F.filter("sections", lambda s: (s.level == 1) & (s.heading != ""))
    return out.withColumn("title", F.coalesce(F.get(top, 0).heading, F.col(key).cast("string")))


def matching(pattern: str) -> Column:
    """Sections whose heading contains the pattern, without regard to case."""
    return F.filter("sections", lambda s: F.coalesce(s.heading.rlike(f"(?iu){pattern}"), F.lit(False)))


def section_text(key: str) -> Column:
    return F.trim(F.array_join(F.transform(matching(SECTION_PATTERNS.get(key, key)), lambda s: s.text), "\n"))


def present(key: str) -> Column:
    return F.size(matching(SECTION_PATTERNS[key])) > 0


def step_count() -> Column:
    """Numbered steps of the first reproduction section; 0 without one."""
    return F.coalesce(F.size(T.numbered_steps(F.get(matching(SECTION_PATTERNS["reproduction_steps"]), 0).text)), F.lit(0))


def needle(pattern: str) -> str:
    """The longest literal, in lower case, that whatever the pattern matches must contain; groups are not nested, and alternatives stand in groups."""
    literals = re.split(r"\([^()]*\)[?*+]?|\[[^\]]*\](?:[?*+]|\{[^}]*\})?|\\.[?*+]?|.[?*+]|\.", pattern)
    return max(literals, key=len).lower()


def occurs(pattern: str) -> Column:
    """Whether the pattern occurs in the report; an expression is run only where its literal is in ``low``, the report's :func:`T.lowered` text."""
    return F.contains(F.col("low"), F.lit(needle(pattern))) & F.col("raw_text").rlike(f"(?iu){pattern}")


def hits(patterns: tuple[str, ...]) -> Column:
    """How many of the patterns occur in the whole report."""
    return sum((occurs(p).cast("int") for p in patterns), F.lit(0))


def boundary_denials(low: Column | None = None) -> Column:
    """(outright, conditional): whether a clause denies a boundary outright, or under a condition that governs it; ``low`` is the :func:`T.lowered` text, if it is there."""
    inside = f"[^{D.STOP}{D.SOFT}{D.PARAGRAPH}]"
    begun = None if low is None else reduce(or_, (F.contains(low, F.lit(needle(p))) for p in NO_BOUNDARY))
    return D.denied(F.col("raw_text"), tuple(p.replace("[^.?!]", inside) for p in NO_BOUNDARY), begun)


def _result(decision: Column, confidence: Column, dims: list[Column]) -> Column:
    return F.struct(
        decision.alias("decision"), F.greatest(F.lit(0.05), F.least(confidence, F.lit(0.99))).alias("confidence"),
        F.map_from_arrays(F.array(*map(F.lit, DIMENSIONS)), F.array(*(d.cast("double") for d in dims))).alias("dimensions"),
    )


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


FINDINGS = "array<struct<code:string,severity:string,evidence:string>>"
#: Characters of evidence that a finding keeps.
EVIDENCE = 80


def first_hit(patterns: tuple[str, ...]) -> Column:
    """What the first of the patterns that occurs in the report matches, else NULL."""
    return F.coalesce(*(F.nullif(F.regexp_extract("raw_text", f"(?iu)({p})", 1), F.lit("")) for p in patterns))


def _finding(when: Column, code: str, severity: str, evidence: Column | None = None) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit("") if evidence is None else F.substring(evidence, 1, EVIDENCE)).alias("evidence")))


@dataclass(frozen=True)
class Evaluator:
    """A named evaluator: expressions over the columns of a structured report, in steps that may use each other's columns."""

    name: str
    steps: tuple[Callable[[], dict[str, Column]], ...]
    result: Callable[[], Column]
    needs_labels: bool = False
    found: Callable[[], Column] | None = None

    def apply(self, reports: DataFrame, findings: bool = False) -> DataFrame:
        """(report_id, evaluator_name, decision, confidence, dimensions and, if wanted, findings); labels are dropped first unless needed."""
        labels = [c for c in reports.columns if c.startswith("expected_") or c in ("report_class", "correct")]
        rows = reports if self.needs_labels else reports.drop(*labels)
        for step in self.steps:
            rows = rows.withColumns(step())
        listed = [(self.found() if self.found else F.array().cast(FINDINGS)).alias("findings")] if findings else []
        return rows.select("report_id", F.lit(self.name).alias("evaluator_name"), self.result().alias("r"), *listed).select("report_id", "evaluator_name", "r.*", *(["findings"] if findings else []))


def _rules_text() -> dict[str, Column]:
    return {"low": T.lowered(F.col("raw_text"))}


def _rules_signals() -> dict[str, Column]:
    heading, noise = r"(?imu)^#{1,3}\s+%s\s*$", ("additional context", "background information")
    said = lambda *words: reduce(or_, (F.contains(F.col("low"), F.lit(w)) for w in words))
    return {
        "missing": sum(((~present(k)).cast("int") for k in SECTION_PATTERNS), F.lit(0)), "has_versions": present("affected_versions"), "has_steps": present("reproduction_steps"),
        "steps": step_count(), "fab": hits(FABRICATION), "sco": hits(SCOPE_EXPANSION), "inf": hits(INFLATION), "con": hits(CONTRADICTION), "att": hits(ATTRIBUTION), "unc": hits(UNCERTAINTY),
        "denials": boundary_denials(F.col("low")), "claims": section_text("summary").rlike(f"(?i){STRONG_CLAIM}"),
        "refs": said("references") & F.col("raw_text").rlike(heading % "references"), "noise": F.when(~said(*noise), 0).otherwise(F.regexp_count("raw_text", F.lit(heading % f"(?:{'|'.join(noise)})"))),
    }


def _rules_dimensions() -> dict[str, Column]:
    c = F.col
    share = 1 - c("missing") / 7.0
    step = F.when(~c("has_steps"), 0.05).when(c("steps") == 0, 0.1).when(c("steps") == 1, 0.35).when(c("steps") == 2, 0.65).otherwise(1.0)
    consistency = F.greatest(F.lit(0.0), 1 - 0.45 * c("fab") - 0.55 * c("con") - 0.3 * c("att"))
    return {
        "d_repro": F.least(F.lit(1.0), share * 0.35 + step * 0.65),
        "d_cons": F.when(c("claims") & (c("con") > 0), F.greatest(F.lit(0.0), consistency - 0.15)).otherwise(consistency),
        "d_evid": _clamped(share * 0.7 + F.when(c("fab") == 0, 1.0).otherwise(0.6) * 0.3 - 0.05 * c("fab") - F.when(c("refs"), 0.1).otherwise(0.0)),
        "d_cal": F.greatest(F.lit(0.0), 1 - F.when(c("inf") > 0, 0.35).otherwise(0.0) - 0.1 * c("inf") - F.when(c("denials.outright") & (c("inf") > 0), 0.2).otherwise(0.0)),
        "d_scope": _clamped(1 - F.when(c("sco") > 0, 0.4).otherwise(0.0) - F.when(~c("has_versions"), 0.25).otherwise(0.0)),
    }


def _rules_result() -> Column:
    c = F.col
    dims = [c(k) for k in ("d_repro", "d_evid", "d_cons", "d_cal", "d_scope")]
    overall = sum((F.round(d, 3) for d in dims), F.lit(0.0)) / 5
    slack = 0.02 * c("noise")
    flagged = (c("fab") + c("sco") + c("inf") + c("att") > 0) | c("refs")
    weak = (c("d_repro") < 0.8 - slack) | (c("d_evid") < 0.8 - slack) | (overall < 0.78 - slack)
    reject = (c("d_cons") <= 0.45) | c("denials.outright") | (c("con") > 0)
    decision = F.when(reject, REJECT).when(flagged | weak | c("denials.conditional") | (c("unc") > 0), REVIEW).otherwise(ACCEPT)
    confidence = (
        F.when(decision == ACCEPT, F.least(F.lit(0.95), 0.5 + (overall - 0.78) * 1.6)).when(decision == REJECT, F.least(F.lit(0.9), 0.6 + F.greatest(F.lit(0.0), 0.45 - c("d_cons")) * 0.5))
        .when(c("unc") > 0, 0.5).otherwise(0.45)
    )
    return _result(decision, confidence, dims)


def _rules_findings() -> Column:
    """Findings in the order of the checks; of most kinds the first hit only, of fabrications each pattern's."""
    c = F.col
    noise = F.regexp_extract("raw_text", r"(?imu)^#{1,3}\s+(additional context|background information)\s*$", 1)
    made = [_finding(~present(k), f"MISSING_SECTION_{k.upper()}", "medium") for k in SECTION_PATTERNS]
    made += [_finding(c("has_steps") & (c("steps") == 0), "EMPTY_REPRO_STEPS", "high"), _finding(c("has_steps") & c("steps").between(1, 2), "THIN_REPRO_STEPS", "medium")]
    made += [_finding(occurs(p), "FABRICATED_IDENTIFIER_CLAIM", "high", first_hit((p,))) for p in FABRICATION]
    made += [
        _finding(c("sco") > 0, "SCOPE_EXPANSION_CLAIM", "medium", first_hit(SCOPE_EXPANSION)), _finding(c("inf") > 0, "IMPACT_INFLATION_LANGUAGE", "medium", first_hit(INFLATION)),
        _finding(c("denials.outright"), "NO_SECURITY_BOUNDARY_STATED", "high", first_hit(NO_BOUNDARY)), _finding(c("denials.conditional"), "CONDITIONAL_BOUNDARY_STATEMENT", "medium", first_hit(NO_BOUNDARY)),
        _finding(c("con") > 0, "CLAIM_EVIDENCE_CONFLICT", "critical", first_hit(CONTRADICTION)), _finding(~c("has_versions"), "MISSING_AFFECTED_VERSIONS", "low"),
        _finding(c("att") > 0, "ATTRIBUTION_CLAIM_UNVERIFIED", "medium", first_hit(ATTRIBUTION)), _finding(c("refs"), "UNVERIFIED_REFERENCE_BLOCK", "low"),
        _finding(c("noise") > 0, "TANGENTIAL_CONTENT_SECTION", "info", noise), _finding(c("unc") > 0, "SELF_DECLARED_UNCERTAINTY", "medium", first_hit(UNCERTAINTY)),
    ]
    return F.array_compact(F.array(*made)).cast(FINDINGS)


def _graph_nodes() -> dict[str, Column]:
    def claims(t):
        return t.rlike(f"(?iu){SEVERITY_WORDS}") | t.rlike(f"(?iu){CONSEQUENCE_WORDS}")

    observed, boundary = section_text("observed_result"), section_text("expected_security_boundary")
    return {
        "claim": claims(section_text("summary")) | claims(section_text(r"\bimpact\b")), "component": section_text("affected_component") != "", "steps": step_count(),
        "observed": observed != "", "undermined": observed.rlike(f"(?iu){GRAPH_UNDERMINES}"), "boundary": boundary != "", "negated": boundary.rlike(f"(?iu){GRAPH_NO_BOUNDARY}"),
        "hedged": F.col("raw_text").rlike(f"(?iu){GRAPH_HEDGED}"),
    }


def _graph_edges() -> dict[str, Column]:
    c = F.col
    return {
        "e1": c("claim") & c("component"), "e2": c("claim") & (c("steps") >= 2) & c("observed"),
        "e3": c("claim") & c("observed") & ~c("undermined"), "e4": c("claim") & c("boundary") & ~c("negated"),
    }


def _graph_result() -> Column:
    c = F.col
    bit = {k: c(k).cast("int") for k in ("e1", "e2", "e3", "e4")}
    edges = sum(bit.values(), F.lit(0))
    support = edges / 4.0
    dims = [
        F.least(F.lit(1.0), F.least(c("steps"), F.lit(3)) / 3.0 * 0.7 + 0.3 * bit["e2"]),
        0.25 * bit["e1"] + 0.35 * bit["e2"] + 0.2 * bit["e3"] + 0.2 * support,
        F.when(c("e4"), 0.45).otherwise(0.15) + 0.2 * bit["e2"],
        F.least(F.lit(1.0), 0.5 + 0.5 * support - F.when(c("hedged"), 0.25).otherwise(0.0)),
        F.when(c("component"), 1.0).otherwise(0.3) * F.when(c("boundary"), 0.8).otherwise(0.5),
    ]
    overall = sum(dims[1:], dims[0]) / 5
    decision = F.when(c("negated") | c("undermined"), REJECT).when(c("hedged"), REVIEW).when(c("claim") & (edges == 4) & (overall >= 0.75), ACCEPT).otherwise(REVIEW)
    confidence = F.when(decision == ACCEPT, F.least(F.lit(0.95), 0.55 + overall - 0.75)).when(decision == REJECT, 0.85).otherwise(0.5)
    return _result(decision, confidence, dims)


#: Distinct tokens that a section needs for full marks.
TOKEN_TARGETS = {"summary": 6, "affected_component": 1, "affected_versions": 1, "preconditions": 6, "reproduction_steps": 6, "observed_result": 6, "expected_security_boundary": 6}
# Words without content.
STOP_WORDS = "a an and are as at be been being but by for from had has have he her his i in is it its of on or our she that the their them there these they this to was we were will with you your".split()


def content_tokens(text: Column) -> Column:
    """Tokens of a folded text without stop words, list numbers and fence lines."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*(?:`{3,}|~{3,}).*$", ""), r"(?m)^ {0,3}\d+[.)][ \t]+", "")
    return F.filter(T.tokens(bare), lambda t: ~t.isin(*STOP_WORDS))


def _body(section: Column) -> Column:
    return F.when(section.level > 0, F.regexp_replace(section.text, r"^[^\n]*\n?", "")).otherwise(section.text)


def _bodies(key: str) -> Column:
    """Text of matching sections without headings, with that of their subsections."""
    pattern = f"(?iu){SECTION_PATTERNS[key]}"
    start = F.struct(F.lit(99).alias("open"), F.lit("").alias("text"))

    def step(acc, s):
        hit = F.coalesce(s.heading.rlike(pattern), F.lit(False)) & (s.level > 0)
        child = s.level > acc.open
        open_ = F.when(child, acc.open).when(hit, s.level).otherwise(99)
        return F.struct(open_.alias("open"), F.when(hit | child, F.concat(acc.text, F.lit("\n"), _body(s))).otherwise(acc.text).alias("text"))

    return F.aggregate("sections", start, step, lambda acc: acc.text)


def _quality_texts() -> dict[str, Column]:
    return {f"b_{k}": T.folded(_bodies(k)) for k in TOKEN_TARGETS}


def _quality_counts() -> dict[str, Column]:
    steps = F.array_distinct(F.filter(F.transform(F.filter(T.lines(F.col("b_reproduction_steps")), lambda x: x.rlike(r"^ {0,3}\d+[.)][ \t]+\S")), content_tokens), lambda t: F.size(t) > 0))
    return {"marks": F.array(*(F.least(F.size(F.array_distinct(T.tokens(F.col(f"b_{k}")))) / float(n), F.lit(1.0)) for k, n in TOKEN_TARGETS.items())), "distinct_steps": steps}


def _quality_result() -> Column:
    detail = F.aggregate(F.transform("distinct_steps", lambda t: F.least(F.size(F.array_distinct(t)) / 8.0, F.lit(1.0))), F.lit(0.0), lambda a, x: a + x)
    n = F.size("distinct_steps")
    repro = 0.5 * F.least(n / 3.0, F.lit(1.0)) + 0.5 * F.when(n > 0, detail / n).otherwise(0.0)
    evid = F.aggregate("marks", F.lit(0.0), lambda a, x: a + x) / 7
    return _result(F.lit(REVIEW), F.lit(0.5), [repro, evid, F.lit(0.5), F.lit(0.5), F.lit(0.5)])


def _oracle_result() -> Column:
    dims = [F.coalesce(F.try_element_at("expected_dimensions", F.lit(d)), F.lit(0.5)) for d in DIMENSIONS]
    return F.struct(
        F.coalesce("expected_decision", F.lit(REVIEW)).alias("decision"), F.lit(1.0).alias("confidence"),
        F.map_from_arrays(F.array(*map(F.lit, DIMENSIONS)), F.array(*dims)).alias("dimensions"),
    )


RULES = Evaluator("rules-baseline", (_rules_text, _rules_signals, _rules_dimensions), _rules_result, found=_rules_findings)
GRAPH = Evaluator("evidence-graph-baseline", (_graph_nodes, _graph_edges), _graph_result)
TEXT_QUALITY = Evaluator("text-quality-baseline", (_quality_texts, _quality_counts), _quality_result)
ORACLE = Evaluator("oracle", (), _oracle_result, needs_labels=True)
CONSTANT = tuple(Evaluator(f"always-{d}", (), lambda d=d: _result(F.lit(d), F.lit(0.5), [F.lit(0.5)] * 5)) for d in DECISIONS)
BUILT_IN = {e.name: e for e in (RULES, GRAPH, TEXT_QUALITY, ORACLE, *CONSTANT)}


def run(cases: DataFrame, evaluators: list[Evaluator]) -> DataFrame:
    """Every evaluator on every structured case; evaluators see an opaque handle and the report, the rows carry the case again."""
    if len({e.name for e in evaluators}) < len(evaluators):
        raise ValueError("two evaluators have the same name")
    hidden = cases.withColumn("report_id", opaque_handle(F.col("case_id")))
    out = None
    for e in evaluators:
        visible = hidden if e.needs_labels else hidden.select("report_id", "raw_text", "sections", "title")
        rows = e.apply(visible)
        out = rows if out is None else out.unionByName(rows)
    return hidden.select("report_id", "case_id").join(out, "report_id").drop("report_id")


def cosine_of_sections(reports: DataFrame, left: str = "summary", right: str = "observed_result") -> DataFrame:
    """(report_id, cosine) of the content tokens of two sections of structured reports."""
    sides = reports.select("report_id", F.explode(F.array(*(F.struct(F.lit(k).alias("side"), content_tokens(T.folded(_bodies(s))).alias("t")) for k, s in enumerate((left, right))))).alias("x"))
    return T.cosine(sides.select("report_id", "x.side", F.explode("x.t").alias("token")), "report_id")
