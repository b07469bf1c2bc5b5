"""Named queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import hashing, safety, text
from assay.operators import audits, integrity, metrics, planning, repeats, resample
from assay.plans import bindings as b
from assay.plans.sql import OUT, PAIRS, REC, VOTES, n, ratio
from assay.registry import query


FLAGSHIP = "decision_accuracy"


SCORED = "expected_decision IS NOT NULL"


@query(REC + f"""SELECT evaluator_name, {n(SCORED)} AS total_cases, {n('ok')} AS correct_cases, {n('expected_decision IS NULL')} AS unscored_cases,
coalesce({ratio(n('ok'), n(SCORED))}, 0) AS decision_accuracy FROM rec GROUP BY evaluator_name""")
def decision_accuracy(spark, sf_dir):
    return metrics.decision_accuracy(b.records(spark, sf_dir))


@query(REC + f"""SELECT evaluator_name, {n("expected_decision <> 'accept'")} AS eligible, {n("expected_decision <> 'accept' AND decision = 'accept'")} AS reassured,
{ratio(n("expected_decision <> 'accept' AND decision = 'accept'"), n("expected_decision <> 'accept'"))} AS false_reassurance_rate FROM rec GROUP BY evaluator_name""")
def false_reassurance(spark, sf_dir):
    return metrics.false_reassurance(b.records(spark, sf_dir))


@query(REC + f"""SELECT evaluator_name, {n("expected_decision = 'accept'")} AS eligible, {n("expected_decision = 'accept' AND decision = 'reject'")} AS rejected,
{ratio(n("expected_decision = 'accept' AND decision = 'reject'"), n("expected_decision = 'accept'"))} AS over_rejection_rate FROM rec GROUP BY evaluator_name""")
def over_rejection(spark, sf_dir):
    return metrics.over_rejection(b.records(spark, sf_dir))


@query(REC + f"""SELECT evaluator_name, {n('changing')} AS eligible, {n('changing AND ok')} AS matched, {ratio(n('changing AND ok'), n('changing'))} AS target_accuracy FROM rec GROUP BY evaluator_name""")
def changing_target_accuracy(spark, sf_dir):
    return metrics.changing_target_accuracy(b.records(spark, sf_dir))


DRIFT = f"""SELECT evaluator_name, count(*) AS considered, {n('p_id IS NOT NULL')} AS paired, {n('p_id IS NULL')} AS missing_parent, {n('decision <> p_decision')} AS moved,
{ratio(n('decision <> p_decision'), n('p_id IS NOT NULL'))} AS drift FROM kin WHERE preserving GROUP BY evaluator_name"""


@query(REC + DRIFT)
def preserving_drift(spark, sf_dir):
    return metrics.preserving_drift(b.records(spark, sf_dir))


_SHOWN = "p_id IS NOT NULL AND (p_expected IS NULL OR p_expected <> 'accept')"
SHOWN = f"""SELECT evaluator_name, count(*) AS considered, {n(_SHOWN)} AS paired, {n(f'NOT ({_SHOWN})')} AS unresolved,
{n(f"{_SHOWN} AND decision = 'accept'")} - {n(f"{_SHOWN} AND p_decision = 'accept'")} AS accept_change,
{ratio(f'''({n(f"{_SHOWN} AND decision = 'accept'")} - {n(f"{_SHOWN} AND p_decision = 'accept'")})''', n(_SHOWN))} AS susceptibility
FROM kin WHERE operator IN ('professionalize_language', 'professionalize_style', 'confidence_overstatement') AND expected_decision <> 'accept' GROUP BY evaluator_name"""


@query(REC + SHOWN)
def presentation_susceptibility(spark, sf_dir):
    return metrics.presentation_susceptibility(b.records(spark, sf_dir))


BINS = f"""SELECT evaluator_name, CAST(least(tenths, 9) AS INTEGER) AS bin, count(*) AS n, {n('ok')} AS correct,
CAST(sum(tenths) AS DOUBLE) / 10 / count(*) AS mean_confidence, {ratio(n('ok'), 'count(*)')} AS accuracy FROM rec WHERE {SCORED} GROUP BY ALL"""


@query(REC + BINS)
def ece_bins(spark, sf_dir):
    return metrics.calibration_bins(b.records(spark, sf_dir))


ECE = f"""SELECT evaluator_name, CAST(sum(n) AS BIGINT) AS in_range, CAST(0 AS BIGINT) AS out_of_range,
list_reduce(list_prepend(CAST(0 AS DOUBLE), list(n * abs(mean_confidence - accuracy) ORDER BY bin)), lambda x, y: x + y) / CAST(sum(n) AS DOUBLE) AS calibration_error FROM ({BINS}) GROUP BY evaluator_name"""


@query(REC + ECE)
def calibration_error(spark, sf_dir):
    return metrics.calibration_error(b.records(spark, sf_dir))


@query(REC + " UNION ALL ".join(f"""SELECT evaluator_name, '{d}' AS dimension, count(*) AS n, CAST(sum(abs(a{k} - e{k})) AS DOUBLE) / 10 / count(*) AS mae FROM rec WHERE {SCORED} GROUP BY evaluator_name""" for k, d in enumerate(metrics.DIMENSIONS)))
def dimension_mae(spark, sf_dir):
    return metrics.dimension_mae(b.records(spark, sf_dir))


@query(REC + f"""SELECT evaluator_name, class, count(*) AS total, {n('ok')} AS correct, {ratio(n('ok'), 'count(*)')} AS accuracy FROM (
SELECT evaluator_name, report_class AS class, ok FROM rec WHERE {SCORED} UNION ALL SELECT evaluator_name, 'canonical_overall', ok FROM rec WHERE {SCORED} AND case_kind = 'canonical') GROUP BY ALL""")
def per_class_accuracy(spark, sf_dir):
    return metrics.per_class_accuracy(b.records(spark, sf_dir))


@query(REC + f""", bundle AS (SELECT * FROM
(SELECT evaluator_name, {n(SCORED)} AS total_cases, {n('ok')} AS correct_cases, coalesce({ratio(n('ok'), n(SCORED))}, 0) AS decision_accuracy,
{ratio(n("expected_decision <> 'accept' AND decision = 'accept'"), n("expected_decision <> 'accept'"))} AS false_reassurance_rate,
{ratio(n("expected_decision = 'accept' AND decision = 'reject'"), n("expected_decision = 'accept'"))} AS over_rejection_rate,
{ratio(n('changing AND ok'), n('changing'))} AS target_accuracy,
{ratio(n("case_kind = 'canonical' AND ok"), n(f"case_kind = 'canonical' AND {SCORED}"))} AS canonical_accuracy FROM rec GROUP BY evaluator_name)
LEFT JOIN (SELECT evaluator_name, drift FROM ({DRIFT})) USING (evaluator_name) LEFT JOIN (SELECT evaluator_name, susceptibility FROM ({SHOWN})) USING (evaluator_name)
LEFT JOIN (SELECT evaluator_name, calibration_error FROM ({ECE})) USING (evaluator_name))
SELECT *, (((((CAST(0 AS DOUBLE) + target_accuracy * CAST(0.4 AS DOUBLE)) + (1 - false_reassurance_rate) * CAST(0.25 AS DOUBLE)) + canonical_accuracy * CAST(0.15 AS DOUBLE)) + (1 - calibration_error) * CAST(0.1 AS DOUBLE)) + (1 - greatest(CAST(0 AS DOUBLE), susceptibility)) * CAST(0.1 AS DOUBLE))
/ (((((CAST(0 AS DOUBLE) + CAST(0.4 AS DOUBLE)) + CAST(0.25 AS DOUBLE)) + CAST(0.15 AS DOUBLE)) + CAST(0.1 AS DOUBLE)) + CAST(0.1 AS DOUBLE)) AS robustness_score FROM bundle""")
def metric_bundle(spark, sf_dir):
    return metrics.metric_bundle(b.records(spark, sf_dir))


_COVER = [
    ("decision_accuracy", "rec", n(SCORED), n("expected_decision IS NULL"), "true"), ("false_reassurance", "rec", n("expected_decision <> 'accept'"), "0", "true"),
    ("over_rejection", "rec", n("expected_decision = 'accept'"), "0", "true"), ("target_accuracy", "rec", n("changing"), "0", "true"),
    ("preserving_drift", "kin", n("p_id IS NOT NULL"), n("p_id IS NULL"), "preserving"),
    ("presentation_susceptibility", "kin", n(_SHOWN), n(f"NOT ({_SHOWN})"), "operator IN ('professionalize_language', 'professionalize_style', 'confidence_overstatement') AND expected_decision <> 'accept'"),
    ("calibration_error", "rec", n(SCORED), "0", "true"),
]


@query(REC + "SELECT *, CASE WHEN eligible = 0 THEN 'no eligible rows for ' || metric END AS undefined_reason FROM (" + " UNION ALL ".join(
    f"SELECT evaluator_name, '{m}' AS metric, {e} AS eligible, CAST({x} AS BIGINT) AS excluded FROM {t} WHERE {w} GROUP BY evaluator_name" for m, t, e, x, w in _COVER) + ")")
def metric_coverage(spark, sf_dir):
    return metrics.metric_coverage(b.records(spark, sf_dir))


@query(REC + f""", bins AS ({BINS.replace('SELECT evaluator_name,', 'SELECT evaluator_name, operator,')}),
ece AS (SELECT evaluator_name, operator, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(n * abs(mean_confidence - accuracy) ORDER BY bin)), lambda x, y: x + y) / CAST(sum(n) AS DOUBLE) AS calibration_error FROM bins WHERE operator IS NOT NULL GROUP BY ALL)
SELECT m.*, calibration_error FROM (SELECT evaluator_name, operator, {n(SCORED)} AS total_cases, {n('ok')} AS correct_cases, {n('expected_decision IS NULL')} AS unscored_cases,
coalesce({ratio(n('ok'), n(SCORED))}, 0) AS decision_accuracy, {n("expected_decision <> 'accept' AND decision = 'accept'")} AS reassured,
{ratio(n("expected_decision <> 'accept' AND decision = 'accept'"), n("expected_decision <> 'accept'"))} AS false_reassurance_rate,
{n('changing AND ok')} AS matched, {ratio(n('changing AND ok'), n('changing'))} AS target_accuracy FROM rec WHERE operator IS NOT NULL GROUP BY ALL) m JOIN ece USING (evaluator_name, operator)""")
def per_operator_metrics(spark, sf_dir):
    return metrics.by_operator(b.records(spark, sf_dir))


@query(REC + f"""SELECT a.*, paired, moved, {ratio('moved', 'paired')} AS drift FROM
(SELECT evaluator_name, report_class, {n(SCORED)} AS total_cases, {n('ok')} AS correct_cases, {n('expected_decision IS NULL')} AS unscored_cases, coalesce({ratio(n('ok'), n(SCORED))}, 0) AS decision_accuracy FROM rec GROUP BY ALL) a
LEFT JOIN (SELECT evaluator_name, report_class, {n('p_class = report_class')} AS paired, {n('p_class = report_class AND decision <> p_decision')} AS moved FROM kin WHERE preserving GROUP BY ALL) d USING (evaluator_name, report_class)""")
def per_class_metrics(spark, sf_dir):
    return metrics.by_class(b.records(spark, sf_dir))


_CODE = """CASE expected_decision || '/' || decision WHEN 'accept/reject' THEN 'over_rejection' WHEN 'accept/needs_manual_review' THEN 'premature_deferral'
WHEN 'reject/accept' THEN 'false_reassurance' WHEN 'reject/needs_manual_review' THEN 'deferred_invalid' WHEN 'needs_manual_review/accept' THEN 'premature_accept'
WHEN 'needs_manual_review/reject' THEN 'over_strict_reject' ELSE 'other_misclassification' END"""


@query(REC + f"SELECT evaluator_name, {_CODE} AS error_code, count(*) AS n FROM rec WHERE {SCORED} AND NOT ok GROUP BY ALL")
def taxonomy(spark, sf_dir):
    return metrics.error_taxonomy(b.records(spark, sf_dir))


@query(REC + f"SELECT evaluator_name, report_class, {_CODE} AS error_code, count(*) AS n FROM rec WHERE {SCORED} AND NOT ok GROUP BY ALL")
def taxonomy_by_class(spark, sf_dir):
    return metrics.error_taxonomy(b.records(spark, sf_dir), ("evaluator_name", "report_class"))


@query(REC + f"SELECT evaluator_name, operator, {_CODE} AS error_code, count(*) AS n FROM rec WHERE {SCORED} AND NOT ok GROUP BY ALL")
def taxonomy_by_operator(spark, sf_dir):
    return metrics.error_taxonomy(b.records(spark, sf_dir), ("evaluator_name", "operator"))


@query(REC + f"""SELECT a.evaluator_name AS evaluator_a, b.evaluator_name AS evaluator_b, count(*) AS cases, {n('a.ok AND NOT b.ok')} AS a_wins, {n('b.ok AND NOT a.ok')} AS b_wins, {n('a.ok = b.ok')} AS ties,
coalesce({ratio(n('a.ok AND NOT b.ok'), n('a.ok <> b.ok'))}, 0) AS a_win_rate
FROM rec a JOIN rec b USING (case_id) WHERE a.evaluator_name < b.evaluator_name AND a.expected_decision IS NOT NULL AND b.expected_decision IS NOT NULL GROUP BY ALL""")
def paired_win_loss(spark, sf_dir):
    return audits.paired_win_loss(b.records(spark, sf_dir))


@query(REC + """SELECT a.evaluator_name AS evaluator_a, b.evaluator_name AS evaluator_b, a.decision AS decision_a, b.decision AS decision_b, count(*) AS n
FROM rec a JOIN rec b USING (case_id) WHERE a.evaluator_name < b.evaluator_name GROUP BY ALL""")
def evaluator_pair_matrix(spark, sf_dir):
    return audits.decision_matrix(b.records(spark, sf_dir))


@query(REC + f""", c AS (SELECT evaluator_name, count(*) AS eligible_children, {n('p_id IS NOT NULL')} AS paired, {n('p_id IS NULL')} AS missing_parent, {n('ok')} AS child_correct,
{n('p_decision = p_expected')} AS parent_correct, {n('ok AND p_decision = p_expected')} AS both_correct, {n('decision <> p_decision')} AS decision_changed, {n("decision = 'needs_manual_review'")} AS child_deferrals
FROM kin WHERE changing GROUP BY evaluator_name)
SELECT *, {ratio('child_correct', 'eligible_children')} AS child_target_accuracy, {ratio('both_correct', 'paired')} AS both_correct_rate, {ratio('decision_changed', 'paired')} AS decision_change_rate,
{ratio('both_correct', 'parent_correct')} AS child_given_parent_correct, {ratio('child_deferrals', 'eligible_children')} AS deferral_rate FROM c""")
def decision_change_audit(spark, sf_dir):
    return audits.decision_change_audit(b.records(spark, sf_dir))


@query(PAIRS + f"""SELECT evaluator_name, count(*) AS paired, {n('a <> b')} AS changed, {n('a = ea AND b = eb')} AS both_correct, {n("a = 'accept'")} AS plain_accept, {n("b = 'accept'")} AS polished_accept,
{n("a <> 'accept' AND b = 'accept'")} AS accept_gain, {n("a = 'accept' AND b <> 'accept'")} AS accept_loss FROM duo WHERE members = 2 GROUP BY evaluator_name""")
def authored_pair_audit(spark, sf_dir):
    return audits.authored_pair_audit(b.records(spark, sf_dir), b.pair_roles(spark, sf_dir))


@query(PAIRS + "SELECT evaluator_name, a || ' -> ' || b AS transition, count(*) AS n FROM duo WHERE members = 2 GROUP BY ALL")
def transition_matrix(spark, sf_dir):
    return audits.transitions(b.records(spark, sf_dir), b.pair_roles(spark, sf_dir))


@query(PAIRS + "SELECT evaluator_name, pair_id, members FROM duo WHERE members <> 2 OR ea IS DISTINCT FROM eb")
def authored_pair_violations(spark, sf_dir):
    return audits.authored_pair_violations(b.records(spark, sf_dir), b.pair_roles(spark, sf_dir)).select("evaluator_name", "pair_id", "members")


@query(REC + f""", p AS (SELECT d AS decision, r.* EXCLUDE (decision) FROM rec r CROSS JOIN (VALUES ('accept'), ('reject'), ('needs_manual_review')) AS v(d) WHERE {SCORED})
SELECT 'always-' || decision AS policy, count(*) AS total, {n('decision = expected_decision')} AS correct, {n('changing')} AS changing, {n('changing AND decision = expected_decision')} AS changing_correct,
{ratio(n('decision = expected_decision'), 'count(*)')} AS agreement, {ratio(n('changing AND decision = expected_decision'), n('changing'))} AS target_accuracy FROM p GROUP BY decision""")
def constant_policy_controls(spark, sf_dir):
    return audits.constant_policies(b.records(spark, sf_dir))


@query(REC + f"""SELECT coalesce(operator, 'canonical') AS operator, {ratio(n("ok AND evaluator_name = 'alpha'"), n("evaluator_name = 'alpha'"))} AS accuracy_alpha,
{ratio(n("ok AND evaluator_name = 'beta'"), n("evaluator_name = 'beta'"))} AS accuracy_beta FROM rec WHERE {SCORED} GROUP BY ALL""")
def results_pivot(spark, sf_dir):
    return audits.results_pivot(b.records(spark, sf_dir), ["alpha", "beta"])


@query(REC + f"""SELECT evaluator_name, report_class, {n('changing')} AS departing, count(*) AS n, min(CASE report_class WHEN 'valid' THEN 'accept' WHEN 'invalid' THEN 'reject' ELSE 'needs_manual_review' END) AS default_decision FROM rec GROUP BY ALL""")
def class_default_join(spark, sf_dir):
    rows = metrics.class_default_rows(b.records(spark, sf_dir))
    return rows.groupBy("evaluator_name", "report_class").agg(F.count_if("departs").alias("departing"), F.count("*").alias("n"), F.min("default_decision").alias("default_decision"))


@query(REC + """SELECT evaluator_name, coalesce(parent_id, case_id) AS cluster, count(*) FILTER (ok) AS correct, count(*) AS cases FROM rec GROUP BY ALL""")
def cluster_tallies(spark, sf_dir):
    return resample.cluster_tallies(b.records(spark, sf_dir)).drop("first_row")


@query(None)
def cluster_bootstrap(spark, sf_dir):
    """All clusters of the records, 2,000 resamples."""
    return resample.cluster_bootstrap(b.records(spark, sf_dir))


@query(None)
def row_bootstrap(spark, sf_dir):
    return resample.row_bootstrap(b.records(spark, sf_dir))


# integrity

@query("""SELECT 'l' || l_orderkey || '-' || l_linenumber AS case_id, CASE WHEN l_orderkey % 10 = 0 THEN 'x' ELSE 'o' END || l_orderkey AS parent_id
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey) LEFT JOIN orders ON l_orderkey = o_orderkey AND l_orderkey % 10 <> 0 WHERE o_orderkey IS NULL""")
def dangling_parent(spark, sf_dir):
    return integrity.dangling_parents(b.records(spark, sf_dir)).select("case_id", "parent_id")


@query("""SELECT 'l' || l_orderkey || '-' || l_linenumber AS case_id, 'raw' AS evaluator_name, 0 AS repeat_index, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    rows = b.read(spark, sf_dir, "lineitem").select(F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber").alias("case_id"), F.lit("raw").alias("evaluator_name"), F.lit(0).alias("repeat_index"))
    return integrity.duplicate_keys(rows)


@query(PAIRS + "SELECT pair_id, count(*) AS members FROM role GROUP BY pair_id HAVING count(*) <> 2")
def odd_pairs(spark, sf_dir):
    return integrity.odd_pairs(b.pair_roles(spark, sf_dir))


@query(REC + """, odd AS (SELECT case_id, evaluator_name, case_kind, CASE WHEN tenths <> 0 THEN parent_id END AS parent_id, operator, CASE WHEN tenths = 9 THEN NOT ok ELSE ok END AS told, ok, tenths FROM rec),
every AS (SELECT * FROM odd UNION ALL SELECT * FROM odd WHERE tenths = 7 AND evaluator_name = 'beta')
SELECT rule, count(*) AS n FROM (SELECT 'correct_flag' AS rule FROM every WHERE told <> ok
UNION ALL SELECT 'missing_link' FROM every WHERE case_kind = 'mutated' AND (parent_id IS NULL OR operator IS NULL)
UNION ALL SELECT 'duplicate_key' FROM every GROUP BY case_id, evaluator_name HAVING count(*) > 1) GROUP BY rule""")
def record_violations(spark, sf_dir):
    """Records whose confidence breaks a rule: 0.9 turns the flag, 0 loses the parent, 0.7 of one evaluator comes twice."""
    rows, tenths = b.records(spark, sf_dir), F.round(F.col("confidence") * 10)
    rows = rows.withColumns({"correct": F.when(tenths == 9, ~F.col("correct")).otherwise(F.col("correct")), "parent_id": F.when(tenths != 0, F.col("parent_id"))})
    twice = F.when((tenths == 7) & (F.col("evaluator_name") == "beta"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return integrity.violations(rows.withColumn("copy", F.explode(twice)), 2 * b.most_records(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n"))


# repeats and outcomes

@query(OUT + f""", c AS (SELECT condition, case_id, count(DISTINCT repeat_index) AS seen, count(DISTINCT decision) AS decisions, max(units) - min(units) AS spread FROM out GROUP BY ALL)
SELECT condition, count(*) AS cases_compared, {n('seen >= 3 AND decisions = 1')} AS unanimous, {n('seen >= 3 AND decisions > 1')} AS flipped, {n('seen < 3')} AS incomplete,
{ratio(n('seen >= 3 AND decisions = 1'), 'count(*)')} AS unanimity_rate, {ratio(n('seen >= 3 AND decisions = 1'), n('seen >= 3'))} AS complete_rate,
coalesce(CAST(sum(spread) FILTER (seen >= 3) * 100 AS DOUBLE) / nullif(CAST({n('seen >= 3')} AS DOUBLE), 0) / 1000000, 0) AS mean_spread FROM c GROUP BY condition""")
def repeat_stability(spark, sf_dir):
    rows = b.outcomes(spark, sf_dir).withColumn("confidence", F.col("units") / F.lit(10000.0))
    return repeats.repeat_stability(rows, 3, ("condition",))


VARIANCE = f"""SELECT condition, case_id, {n("status = 'success'")} AS successes, {n("status = 'failed'")} AS failures, {n("status = 'not_run'")} AS not_run,
{ratio("sum(units) FILTER (status = 'success')", n("status = 'success'"))} AS mean_units,
sqrt(CAST(sum(units * units) FILTER (status = 'success') * {n("status = 'success'")} - sum(units) FILTER (status = 'success') * sum(units) FILTER (status = 'success') AS DOUBLE)
/ nullif(CAST({n("status = 'success'")} * {n("status = 'success'")} AS DOUBLE), 0)) AS sd_units,
max(units) FILTER (status = 'success') - min(units) FILTER (status = 'success') AS range_units, count(DISTINCT decision) FILTER (status = 'success') > 1 AS flip FROM out GROUP BY condition, case_id"""


@query(OUT + VARIANCE)
def confidence_variance(spark, sf_dir):
    return repeats.case_variance(b.outcomes(spark, sf_dir))


@query(OUT + f"""SELECT condition, {n('failures = 0 AND not_run = 0 AND successes >= 2')} AS complete_cases, {n('failures = 0 AND not_run = 0 AND successes >= 2 AND flip')} AS flips,
{n('NOT (failures = 0 AND not_run = 0 AND successes >= 2)')} AS left_out, {ratio(n('failures = 0 AND not_run = 0 AND successes >= 2 AND flip'), n('failures = 0 AND not_run = 0 AND successes >= 2'))} AS flip_rate FROM ({VARIANCE}) GROUP BY condition""")
def flip_rate(spark, sf_dir):
    return repeats.flip_rate(repeats.case_variance(b.outcomes(spark, sf_dir)))


@query(OUT + f"""SELECT condition, count(*) AS planned, {n("status = 'success'")} AS success, {n("status = 'failed'")} AS failed, {n("status = 'not_run'")} AS not_run, {n("status = 'not_run'")} = 0 AS complete FROM out GROUP BY condition""")
def outcome_coverage(spark, sf_dir):
    return repeats.outcome_coverage(b.outcomes(spark, sf_dir))


@query(OUT + "SELECT condition, error_kind, count(*) AS n FROM out WHERE status = 'failed' GROUP BY ALL")
def failure_histogram(spark, sf_dir):
    return repeats.failure_histogram(b.outcomes(spark, sf_dir))


@query(OUT + """, c AS (SELECT DISTINCT condition, case_id FROM out) SELECT condition, case_id, CAST(r AS INTEGER) AS repeat_index FROM c CROSS JOIN (SELECT unnest(range(max(repeat_index) + 1)) AS r FROM out) AS t
WHERE NOT EXISTS (SELECT 1 FROM out o WHERE o.condition = c.condition AND o.case_id = c.case_id AND o.repeat_index = r)""")
def planned_not_seen(spark, sf_dir):
    out = b.outcomes(spark, sf_dir)
    most = out.agg(F.coalesce(F.max("repeat_index"), F.lit(0))).first()[0] + 1
    return repeats.planned_not_seen(out.select("condition", "case_id").distinct(), out, most)


@query(OUT + """, r AS (SELECT case_id, repeat_index FROM out WHERE event_id % 7 <> 0 AND status <> 'not_run')
SELECT coalesce(o.case_id, r.case_id) AS case_id, coalesce(o.repeat_index, r.repeat_index) AS repeat_index,
CASE WHEN r.case_id IS NULL THEN 'success_without_record' ELSE 'record_without_success' END AS problem
FROM (SELECT case_id, repeat_index FROM out WHERE status = 'success') o FULL JOIN r ON o.case_id = r.case_id AND o.repeat_index = r.repeat_index WHERE o.case_id IS NULL OR r.case_id IS NULL""")
def success_without_record(spark, sf_dir):
    out = b.outcomes(spark, sf_dir)
    return repeats.outcome_mismatches(out, out.where("event_id % 7 <> 0 and status <> 'not_run'"))


@query("""SELECT * FROM (SELECT 'o' || l_orderkey AS slot, l_linenumber AS attempt, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INTEGER) AS rank
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE rank <> attempt""")
def attempt_sequence(spark, sf_dir):
    rows = b.read(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("slot"), F.col("l_linenumber").alias("attempt"), F.col("l_linenumber").alias("ordinal")).distinct()
    return repeats.attempt_gaps(rows)


@query(VOTES + """SELECT pair_id, voted, CASE WHEN voted < 3 THEN 'incomplete' WHEN (qy < 2 AND qn < 2) OR (ay < 2 AND an < 2) THEN 'uncertain'
WHEN qy >= 2 AND ay >= 2 THEN 'both' WHEN qy >= 2 THEN 'quality_only' WHEN ay >= 2 THEN 'action_only' ELSE 'neither' END AS category,
voted >= 3 AND least(greatest(qy, qn), greatest(ay, an)) < 3 AS dissent FROM tally""")
def vote_majority(spark, sf_dir):
    return repeats.vote_majority(b.votes(spark, sf_dir))


@query("""SELECT operator, case_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY operator ORDER BY uncertain DESC, h) AS rank FROM (
SELECT 'op' || l_linenumber AS operator, 'l' || l_orderkey || '-' || l_linenumber AS case_id, max(l_returnflag = 'R') AS uncertain, sha256('l' || l_orderkey || '-' || l_linenumber) AS h FROM lineitem GROUP BY l_orderkey, l_linenumber)) WHERE rank <= 3""")
def topk_review_selection(spark, sf_dir):
    rows = b.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_returnflag") == "R").alias("uncertain"))
    case_id = F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber")
    rows = rows.select(F.concat(F.lit("op"), "l_linenumber").alias("operator"), case_id.alias("case_id"), "uncertain", F.sha2(case_id, 256).alias("h"))
    return repeats.top_k(rows, "operator", [F.col("uncertain").desc(), F.col("h")], 3).select("operator", "case_id", "rank")


# planning, hashing, text

@query("""SELECT 'fx-' || item_id AS fixture_id, variant, ['professionalize_language', 'professionalize_style', 'confidence_overstatement', 'remove_reproduction_step'][CAST((idx + variant) % 4 + 1 AS INTEGER)] AS operator,
'mut-' || item_id || '-' || replace(['professionalize_language', 'professionalize_style', 'confidence_overstatement', 'remove_reproduction_step'][CAST((idx + variant) % 4 + 1 AS INTEGER)], '_', '-') || '-' || lpad(CAST(variant + 1 AS VARCHAR), 2, '0') AS case_id
FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id % 3 ORDER BY 'fx-' || item_id) - 1 AS idx FROM benchmark) CROSS JOIN (SELECT CAST(r AS INTEGER) AS variant FROM range(3) AS t(r))""")
def rotation_plan(spark, sf_dir):
    fixtures = b.read(spark, sf_dir, "benchmark").select(F.concat(F.lit("fx-"), "item_id").alias("fixture_id"), F.col("item_id").cast("string").alias("short_name"), F.concat(F.lit("g"), F.col("item_id") % 3).alias("policy"))
    policies = spark.createDataFrame([(f"g{k}", 3, list(b.OPERATORS[:4])) for k in range(3)], "policy string, variants int, operators array<string>")
    return planning.rotation(fixtures, policies).select("fixture_id", "variant", "operator", "case_id")


@query("""SELECT item_id, CAST(CAST(('0x' || substr(sha256('20260825|fx-' || item_id || '|remove_reproduction_step|0'), 1, 16)) AS UBIGINT) AS DECIMAL(20, 0)) AS seed FROM benchmark""")
def seed_derivation(spark, sf_dir):
    return b.read(spark, sf_dir, "benchmark").select("item_id", hashing.derived_seed(F.lit("20260825"), F.concat(F.lit("fx-"), "item_id"), F.lit("remove_reproduction_step"), F.lit("0")).alias("seed"))


@query("SELECT o_orderkey, 'case-' || substr(sha256('o' || o_orderkey), 1, 16) AS handle FROM orders")
def opaque_handle(spark, sf_dir):
    return b.read(spark, sf_dir, "orders").select("o_orderkey", hashing.opaque_handle(F.concat(F.lit("o"), "o_orderkey")).alias("handle"))


@query("""SELECT doc_id, (row_number() OVER (ORDER BY sha256('b' || doc_id)) - 1) // 50 AS batch FROM documents""")
def hash_batches(spark, sf_dir):
    return planning.hash_batches(b.read(spark, sf_dir, "documents").select("doc_id"), F.concat(F.lit("b"), "doc_id"), 50)


@query(r"""SELECT page_id, host, host = 'localhost' OR regexp_matches(host, '\.(localhost|local)$') OR regexp_matches(host, '(^|\.)example\.(com|org|net|edu)$') AS reserved
FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)""")
def reserved_hosts(spark, sf_dir):
    p = b.read(spark, sf_dir, "pages").select("page_id", safety.url_host(F.col("url")).alias("host"))
    return p.withColumn("reserved", safety.is_reserved_name(F.col("host")))


@query(r"""SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(t, '(?i)CVE-\d{4}-\d{4,}'), lambda x: substr(x, 5, 4) <> '2099'))) AS ids FROM (
SELECT doc_id, coalesce(text, '') || ' see Cve-' || CAST(2000 + doc_id % 100 AS VARCHAR) || '-' || CAST(10000 + doc_id AS VARCHAR) || ' and CVE-2099-1234, cve-2021-44' || (doc_id % 90 + 10) AS t FROM documents)""")
def real_year_cves(spark, sf_dir):
    """Texts of documents with references behind them."""
    year, number = (2000 + F.col("doc_id") % 100).cast("string"), (10000 + F.col("doc_id")).cast("string")
    told = F.concat(F.coalesce("text", F.lit("")), F.lit(" see Cve-"), year, F.lit("-"), number, F.lit(" and CVE-2099-1234, cve-2021-44"), (F.col("doc_id") % 90 + 10).cast("string"))
    return b.read(spark, sf_dir, "documents").select("doc_id", safety.real_year_cves(told).alias("ids"))


TOK = r"""WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*') AS t FROM documents)
"""


@query(TOK + "SELECT doc_id, CAST(len(t) AS INTEGER) AS tokens, CAST(len(list_distinct(t)) AS INTEGER) AS distinct_tokens FROM tok")
def token_stats(spark, sf_dir):
    t = text.tokens(F.col("text"))
    return b.read(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("distinct_tokens"))


@query(r"""SELECT doc_id, CAST(len(l) AS INTEGER) AS lines, CAST(len(l) - len(list_distinct(l)) AS INTEGER) AS duplicate_lines FROM (
SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '[^ ]+')) >= 4) AS l FROM documents)""")
def duplicate_lines(spark, sf_dir):
    return b.read(spark, sf_dir, "documents").select("doc_id", *text.duplicate_lines(F.col("text"), 4))


@query(r"""WITH side AS (SELECT conv_id, turn % 2 AS side, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*')) AS tok FROM conversations),
c AS (SELECT conv_id, side, tok, count(*) AS n FROM side GROUP BY ALL),
norm AS (SELECT conv_id, side, sum(n * n) AS s FROM c GROUP BY ALL),
dot AS (SELECT a.conv_id, sum(a.n * b.n) AS d FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.tok = b.tok AND a.side = 0 AND b.side = 1 GROUP BY ALL)
SELECT x.conv_id, CAST(coalesce(d, 0) AS DOUBLE) / sqrt(CAST(x.s * y.s AS DOUBLE)) AS cosine FROM norm x JOIN norm y ON x.conv_id = y.conv_id AND x.side = 0 AND y.side = 1 LEFT JOIN dot ON dot.conv_id = x.conv_id""")
def text_cosine(spark, sf_dir):
    rows = b.read(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") % 2).alias("side"), F.explode(text.tokens(F.col("text"))).alias("token"))
    return text.cosine(rows, "conv_id")


@query("""SELECT conv_id, turn, role, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM conversations""")
def turn_sections(spark, sf_dir):
    return text.running_sections(b.read(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "role", "section")
