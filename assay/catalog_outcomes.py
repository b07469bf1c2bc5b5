"""Queries of decoded answers, external evaluators, their failures and published analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay import storage
from assay.operators import analysis, audits, cards, distributions, external, ledgers, metrics, spans, supplements
from assay.plans import bindings as b
from assay.plans import folders, heads, outside, rounds
from assay.plans import reports as rb
from assay.plans.sql import REC, n, ratio
from assay.registry import query
from assay.schema import DECISIONS, is_correct
from assay.sources import corpus


@query(heads.DECODED + f"""SELECT "order", line, failure, CASE WHEN failure IS NULL THEN {heads.CHOSEN} END AS decision,
CASE WHEN failure IS NULL THEN round(CASE option WHEN '{heads.LABELS.options[0]}' THEN p1 WHEN '{heads.LABELS.options[1]}' THEN p2 ELSE p3 END / CAST(total AS DOUBLE), 9) END AS selected_probability,
CASE WHEN failure IS NULL THEN round(p2 / CAST(total AS DOUBLE), 9) END AS p_reject, CASE WHEN failure IS NULL AND d > 0 THEN 15 * t / 100.0 END AS head_confidence,
CASE WHEN failure IS NULL THEN round((s1 + s2 + s3 + s4 + s5) / 200.0, 9) END AS values_sum, CASE WHEN failure IS NULL THEN round((s1 // 2 + s5 // 2) / 100.0, 9) END AS top_levels, CASE WHEN failure IS NULL THEN CAST(x AS DOUBLE) END AS input_tokens FROM f""")
def decoded_answers(spark, sf_dir):
    rows = distributions.decoded(heads.answers(spark, sf_dir), heads.LABELS)
    top = F.col("dimension_probabilities")
    return rows.select(
        "order", "line", "failure", "decision", F.round("selected_probability", 9).alias("selected_probability"), F.round(F.col("decision_probabilities")[DECISIONS[1]], 9).alias("p_reject"), "head_confidence",
        F.round(distributions.exact_sum(F.map_values("dimension_values")), 9).alias("values_sum"), F.round(top["reproducibility"]["2"] + top["scope_consistency"]["2"], 9).alias("top_levels"), F.col("usage.input_tokens").alias("input_tokens"),
    )


@query(heads.DECODED + "SELECT coalesce(failure, 'decoded') AS outcome, count(*) AS n FROM f GROUP BY ALL")
def answer_failures(spark, sf_dir):
    """Answers by what came of them."""
    rows = distributions.decoded(heads.answers(spark, sf_dir), heads.LABELS)
    return rows.groupBy(F.coalesce("failure", F.lit("decoded")).alias("outcome")).agg(F.count("*").alias("n"))


def _cases(spark, sf_dir):
    return b.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("case_id"), F.col("text").alias("raw_text"), F.lit("").alias("title"))


@query(outside.SQL + "SELECT evaluator_name, version, doc_id, decision, confidence, reproducibility, n_findings, error_kind, detail FROM x")
def external_attempts(spark, sf_dir):
    """Two evaluators from outside on every document; one of them fails on many."""
    rows = external.attempts(_cases(spark, sf_dir), [outside.Stops(), outside.HASTY])
    return rows.select(
        "evaluator_name", F.col("evaluator_version").alias("version"), F.col("case_id").cast("long").alias("doc_id"), "decision", "confidence", F.col("dimensions")["reproducibility"].alias("reproducibility"),
        F.when(F.col("decision").isNotNull(), F.size("findings")).alias("n_findings"), "error_kind", "detail",
    )


@query(outside.SQL + """SELECT evaluator_name, planned, scored, failed, CAST(0 AS BIGINT) AS clashing, CAST(0 AS BIGINT) AS missing, true AS complete FROM
(SELECT evaluator_name, count(DISTINCT doc_id) AS planned, count(DISTINCT doc_id) FILTER (error_kind IS NULL) AS scored, count(DISTINCT doc_id) FILTER (error_kind IS NOT NULL) AS failed FROM x GROUP BY ALL)""")
def external_accounting(spark, sf_dir):
    """Outcomes of these evaluators, split into records and failures, against the planned cases."""
    cases = _cases(spark, sf_dir)
    records, failures = external.outcomes(cases, [outside.Stops(), outside.HASTY])
    return ledgers.accounting(records, failures, cases, [outside.Stops.name, outside.HASTY.name]).select("evaluator_name", "planned", "scored", "failed", "clashing", "missing", "complete")


@query(REC + f""", told AS (SELECT *, tenths = 10 AS late FROM rec WHERE tenths IS NOT NULL)
SELECT evaluator_name, count(*) AS planned, count(*) FILTER (NOT late) AS scored, count(*) FILTER (late) AS failed, CAST(0 AS BIGINT) AS not_run, {ratio('count(*) FILTER (NOT late AND ok)', 'count(*) FILTER (NOT late AND expected_decision IS NOT NULL)')} AS decision_accuracy,
'' AS problems, CASE evaluator_name WHEN 'alpha' THEN 'metrics' ELSE '' END AS problems_if_changed, 'coverage.planned coverage.not_run' AS problems_if_planned FROM told GROUP BY evaluator_name""")
def analysis_round_trip(spark, sf_dir):
    """An analysis published and read back: against its tables, against records with other decisions, and against an index with a case more."""
    stored = b.scratch(spark, "records")
    b.records(spark, sf_dir).write.parquet(stored)
    rows = spark.read.parquet(stored)
    late = F.round(F.col("confidence") * 10) == 10
    failures = rows.where(late).select("case_id", "evaluator_name", "repeat_index", F.lit("failed").alias("status"), F.lit("deadline").alias("error_kind"))
    records, index = rows.where(~late), storage.stored(rows.select("case_id").distinct(), "index")  # read by each of the accounts below
    place = analysis.publish(b.scratch(spark, "analysis"), spark, analysis.document(records, failures, index))
    own = analysis.measured(records, failures)  # of the tables as they are read back, once for both indexes
    made = analysis.verified(place, spark, records, failures, index, own=own)
    turned = F.when((F.col("evaluator_name") == "alpha") & (F.col("case_kind") == "mutated") & (F.col("decision") == "accept"), "reject").otherwise(F.col("decision"))
    found = [
        [], analysis.problems(made, records.withColumn("decision", turned).withColumn("correct", is_correct()), failures, index),
        analysis.problems(made, records, failures, index.union(spark.range(1).select(F.lit("one more"))), own=own),
    ]
    assert ("records.digest", "") in found[1] and ("records.digest", "") not in found[2]
    told = [(name, *(made["coverage"][name][k] for k in analysis.COVERAGE), made["metrics"][name]["decision_accuracy"], *(" ".join(w for w, e in f if e == name) for f in found)) for name in made["evaluators"]]
    return spark.createDataFrame(told, "evaluator_name string, planned long, scored long, failed long, not_run long, decision_accuracy double, problems string, problems_if_changed string, problems_if_planned string")


@query("""SELECT l_returnflag, count(*) AS rows, true AS same_in_any_layout, false AS same_if_changed, false AS same_if_repeated FROM lineitem GROUP BY ALL""")
def table_digests(spark, sf_dir):
    """Digests of line items by flag: in another layout and order of columns, with one tax changed in each group, and with one row twice."""
    items = b.read(spark, sf_dir, "lineitem")
    one = items.groupBy("l_returnflag").agg(F.min(F.struct(*[c for c in items.columns if c != "l_returnflag"])).alias("x")).select("l_returnflag", "x.*").select(items.columns)
    least = items.groupBy("l_returnflag").agg(F.min("l_orderkey").alias("k"))
    changed = items.join(F.broadcast(least), "l_returnflag").withColumn("l_tax", F.when(F.col("l_orderkey") == F.col("k"), F.col("l_tax") + 1).otherwise(F.col("l_tax"))).drop("k")
    digest = lambda df, name: analysis.table_digest(df, "l_returnflag").select("l_returnflag", F.col("rows").alias(f"{name}_rows"), F.col("digest").alias(name))
    out = digest(items, "own")
    for name, df in (("laid", items.repartition(7, "l_suppkey").select(*reversed(items.columns))), ("changed", changed), ("twice", items.union(one))):
        out = out.join(digest(df, name), "l_returnflag")
    same = lambda name: F.col("own") == F.col(name)
    return out.select("l_returnflag", F.col("own_rows").alias("rows"), same("laid").alias("same_in_any_layout"), same("changed").alias("same_if_changed"), same("twice").alias("same_if_repeated"))


def _rounds(spark, sf_dir, of_plan=("slot", "round", "previous_attempts", "prior_digest")):
    """Ledger, plan and protocols of supplements, written once; of the plan the columns that are read."""
    stored = {}
    for name, made in (("ledger", lambda: rounds.ledger(spark, sf_dir)), ("plan", lambda: rounds.plan(stored["ledger"]).select(*of_plan)), ("protocols", lambda: rounds.protocols(stored["ledger"], stored["plan"], 2))):
        path = b.scratch(spark, name)
        made().write.parquet(path)
        stored[name] = spark.read.parquet(path)
    return stored["ledger"].select(*rounds.OWN), stored["plan"], stored["protocols"]


@query(rounds.SQL + "SELECT slot, CAST(round AS INTEGER) AS round, problem FROM problems")
def supplement_problems(spark, sf_dir):
    """What is wrong with the attempts and plans of supplements."""
    ledger, plan, _ = _rounds(spark, sf_dir)
    return supplements.slot_problems(ledger, plan, cap=2)


@query(rounds.SQL + """, s AS (SELECT m.round, count(*) FILTER (b.round = m.round) AS requests FROM b, (SELECT unnest([1, 2]) AS round) m GROUP BY ALL),
x AS (SELECT round, count(DISTINCT k) AS slots FROM p GROUP BY ALL), y AS (SELECT round, requests, 2 * (slots + CASE WHEN round = 1 THEN (SELECT count(*) FROM c WHERE n = 1) ELSE 0 END) AS allowed FROM s JOIN x USING (round))
SELECT CAST(round AS INTEGER) AS round, 'too_many_requests' AS problem FROM y WHERE requests > allowed UNION ALL SELECT 2, 'prior_rows'""")
def supplement_round_problems(spark, sf_dir):
    """Rounds whose protocol does not fit: the second one was made on another history."""
    # the digests of slots say nothing about a round, so none are made
    return supplements.round_problems(*_rounds(spark, sf_dir, of_plan=("slot", "round")), cap=2)


@query(folders.SQL)
def discovered_fixtures(spark, sf_dir):
    """Manifests that no index hides, with what is wrong with their reports."""
    found = corpus.fixtures(folders.files(spark, sf_dir), folders.ROOT)
    return found.select("folder", "kind", "id", "problem", F.length("raw_text").alias("chars"))


@query(rb.SQL + rb.SECTIONS + """, n AS (SELECT doc_id, length(coalesce(text, '')) AS size FROM documents)
SELECT doc_id, ordinal, CASE WHEN size % 11 = 0 THEN 'foreign' WHEN size % 3 = 0 THEN 'stale' WHEN size % 7 = 0 AND ordinal = 0 THEN 'outside' WHEN size % 7 = 0 AND ordinal = 1 THEN 'other_text' WHEN size % 5 = 0 AND ordinal = 1 THEN 'other_heading' END AS fault FROM sec JOIN n USING (doc_id)""")
def span_faults(spark, sf_dir):
    """Spans of all sections, some of them of other lines or another heading, against documents some of which have grown or are gone; sizes of the texts decide."""
    sizes = b.read(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    reports = rb.reports(spark, sf_dir)
    now = reports.join(sizes.where("size % 11 <> 0"), "doc_id").select("doc_id", F.when(F.col("size") % 3 == 0, F.concat("raw_text", F.lit("more\n"))).otherwise(F.col("raw_text")).alias("raw_text"))
    taken = spans.captured(reports).join(sizes, "doc_id")
    far, near = F.col("size") % 7 == 0, F.col("ordinal") == 1
    taken = taken.withColumns({
        "end_line": F.when(far & (F.col("ordinal") == 0), 1_000_000).when(far & near, F.col("end_line") - 1).otherwise(F.col("end_line")), "heading": F.when(near & (F.col("size") % 5 == 0), "Other").otherwise(F.col("heading")),
    }).drop("size")
    return spans.checked(taken, now).select("doc_id", "ordinal", "fault")


@query("""WITH i AS (SELECT l_orderkey AS k, l_linenumber AS l, min(l_returnflag) AS f, min(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT 'o' || k AS card_id, count(*) AS n_claims, string_agg('l' || l || ':' || CAST(CAST(q AS INTEGER) AS VARCHAR), ' ' ORDER BY l) AS claims, 'o' || min(o_custkey) AS context, false AS tells
FROM i JOIN orders ON k = o_orderkey GROUP BY k""")
def card_views(spark, sf_dir):
    """What annotators see of cards made of orders and their items, whose flags are the answers."""
    items = b.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"), F.min("l_quantity").cast("int").alias("q"))
    claim = F.struct("l_linenumber", F.concat(F.lit("l"), "l_linenumber").alias("claim_id"), F.struct(F.col("q").alias("quantity"), F.col("f").alias("answer")).alias("shown"), F.col("f").alias("status"))
    claims = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(claim)).alias("claims"))  # an order has seven lines at most
    rows = claims.join(b.read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("o"), "o_orderkey").alias("card_id"), F.lit("1").alias("schema_version"), F.col("o_orderstatus").alias("expected_action"),
        F.struct(
            F.sha2(F.col("o_orderkey").cast("string"), 256).alias("opaque_id"), F.create_map(F.lit("customer"), F.struct(F.concat(F.lit("o"), "o_custkey").alias("name"), F.col("o_orderstatus").alias("ground_truth"))).alias("context"),
            F.col("o_orderpriority").alias("report"), F.array(F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("rationale"))).alias("artifacts"), "claims",
        ).alias("input"),
    )
    shown = cards.views(rows)
    assert cards.answer_fields(rows.schema) and not cards.answer_fields(shown.schema)
    tells = cards.serialized(shown).select("card_id", F.col("view").rlike('"(status|answer|rationale|ground_truth|expected_action)"').alias("tells"))
    told = F.array_join(F.transform("claims", lambda c: F.concat(c.claim_id, F.lit(":"), c.shown.quantity.cast("string"))), " ")
    return shown.select("card_id", F.size("claims").cast("long").alias("n_claims"), told.alias("claims"), F.col("context")["customer"]["name"].alias("context")).join(tells, "card_id")


_LEVELS = [("total", "NULL", "true"), ("report_class", "report_class", "true"), ("operator", "operator", "operator IS NOT NULL"), ("canonical", "'canonical_overall'", "case_kind = 'canonical'")]


@query(REC + " UNION ALL ".join(f"""SELECT evaluator_name, '{level}' AS level, CAST({value} AS VARCHAR) AS value, {n('expected_decision IS NOT NULL')} AS total_cases, {n('ok')} AS correct_cases, {n('expected_decision IS NULL')} AS unscored_cases,
coalesce({ratio(n('ok'), n('expected_decision IS NOT NULL'))}, 0) AS decision_accuracy, {n("expected_decision <> 'accept' AND decision = 'accept'")} AS reassured, {n('changing AND ok')} AS matched,
{ratio(n("expected_decision = 'accept' AND decision = 'reject'"), n("expected_decision = 'accept'"))} AS over_rejection_rate FROM rec WHERE {kept} GROUP BY ALL""" for level, value, kept in _LEVELS))
def metric_breakdown(spark, sf_dir):
    """Total, classes, operators and canonical rows from one scan."""
    return metrics.breakdown(b.records(spark, sf_dir)).select("evaluator_name", "level", "value", "total_cases", "correct_cases", "unscored_cases", "decision_accuracy", "reassured", "matched", "over_rejection_rate")


@query(rb.SQL + """SELECT arm, count(*) AS total, count(*) FILTER (decision = 'accept') AS accepted, count(*) FILTER (arm <> 'original') AS text_changed, CAST(0 AS BIGINT) AS decision_changed
FROM r CROSS JOIN (SELECT unnest(['original', 'style', 'cue', 'composite']) AS arm) GROUP BY arm""")
def intervention_audit(spark, sf_dir):
    """Every report in four arms: neither style nor an authorisation cue moves the rules."""
    arms = audits.intervention_arms(rb.reports(spark, sf_dir).select(F.col("doc_id").cast("string").alias("case_id"), "raw_text"))
    return audits.intervention_audit(arms)
