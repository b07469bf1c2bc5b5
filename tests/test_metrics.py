import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assay.operators import audits, integrity, metrics, repeats, resample
from assay.schema import DIMENSIONS

SCHEMA = (
    "case_id string, case_kind string, parent_id string, operator string, report_class string, expected_decision string, evaluator_name string, repeat_index int, "
    "decision string, confidence double, correct boolean, row_id long, dimensions map<string,double>, expected_dimensions map<string,double>"
)
D = {d: 0.5 for d in DIMENSIONS}


def rec(case_id, expected, decision, kind="canonical", parent=None, operator=None, cls="valid", who="a", repeat=0, conf=0.5, dims=None):
    return (case_id, kind, parent, operator, cls, expected, who, repeat, decision, conf, expected == decision, 0, dims or D, D)


@pytest.fixture()
def table(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def only(df):
    (row,) = df.collect()
    return row


def test_empty_metrics_are_null_but_accuracy_is_zero(table):
    b = only(metrics.metric_bundle(table([rec("c", None, "accept")])))
    assert b["decision_accuracy"] == 0 and b["total_cases"] == 0
    assert {k: b[k] for k in ("false_reassurance_rate", "over_rejection_rate", "target_accuracy", "drift", "susceptibility", "calibration_error", "canonical_accuracy", "robustness_score") if b[k] is not None} == {}
    assert metrics.metric_bundle(table([])).count() == 0


def test_rates(table):
    rows = table([rec("c1", "accept", "accept"), rec("c2", "accept", "reject"), rec("c3", "reject", "accept", cls="invalid"), rec("c4", "reject", "reject", cls="invalid"), rec("c5", None, "accept")])
    b = only(metrics.metric_bundle(rows))
    assert (b["total_cases"], b["correct_cases"], b["decision_accuracy"]) == (4, 2, 0.5)
    assert (b["false_reassurance_rate"], b["over_rejection_rate"]) == (0.5, 0.5)
    codes = {r["error_code"]: r["n"] for r in metrics.error_taxonomy(rows).collect()}
    assert codes == {"over_rejection": 1, "false_reassurance": 1}


def test_calibration_edges(table):
    rows = [rec(f"c{k}", "accept", "accept" if k < 5 else "reject", conf=0.5) for k in range(10)] + [rec("x", "accept", "reject", conf=0.6)]
    assert math.isclose(only(metrics.calibration_error(table(rows)))["calibration_error"], 10 / 11 * 0.0 + 1 / 11 * 0.6)
    top = table([rec("a", "accept", "accept", conf=1.0), rec("b", "accept", "accept", conf=0.95), rec("c", "accept", "accept", conf=1.5), rec("d", "accept", "accept", conf=float("nan"))])
    (b,) = metrics.calibration_bins(top).collect()
    assert (b["bin"], b["n"]) == (9, 2) and only(metrics.calibration_error(top))["out_of_range"] == 2
    bins = table([rec(f"e{k}", "accept", "accept", conf=k / 10) for k in range(11)])
    assert sorted((r["bin"], r["n"]) for r in metrics.calibration_bins(bins).collect()) == [*((k, 1) for k in range(9)), (9, 2)]


def test_pairs_never_cross_evaluator_or_repeat(table):
    rows = [rec("p", "reject", "reject", cls="invalid"), rec("p", "reject", "accept", cls="invalid", who="b"), rec("p", "reject", "accept", cls="invalid", repeat=1)]
    kid = dict(kind="mutated", parent="p", operator="professionalize_style", cls="invalid")
    rows += [rec("k", "reject", "accept", **kid), rec("k", "reject", "accept", who="b", **kid), rec("k", "reject", "accept", repeat=1, **kid), rec("o", "reject", "accept", kind="mutated", parent="gone", operator="professionalize_style", cls="invalid")]
    drift = {r["evaluator_name"]: r for r in metrics.preserving_drift(table(rows)).collect()}
    assert (drift["a"]["paired"], drift["a"]["moved"], drift["a"]["missing_parent"], drift["a"]["drift"]) == (2, 1, 1, 0.5)
    assert drift["b"]["drift"] == 0
    shown = {r["evaluator_name"]: r for r in metrics.presentation_susceptibility(table(rows)).collect()}
    assert shown["a"]["susceptibility"] == 0.5 and shown["a"]["unresolved"] == 1 and shown["b"]["susceptibility"] == 0


def test_changing_targets_and_audit(table):
    rows = [rec("p", "accept", "accept"), rec("k", "reject", "reject", kind="mutated", parent="p", operator="x"), rec("k2", "reject", "needs_manual_review", kind="mutated", parent="q", operator="x")]
    assert only(metrics.changing_target_accuracy(table(rows)))["target_accuracy"] == 0.5
    a = only(audits.decision_change_audit(table(rows)))
    assert (a["eligible_children"], a["paired"], a["missing_parent"], a["both_correct"], a["decision_changed"], a["child_deferrals"]) == (2, 1, 1, 1, 1, 1)
    c = {r["policy"]: r for r in audits.constant_policies(table(rows)).collect()}
    assert c["always-reject"]["target_accuracy"] == 1 and c["always-accept"]["agreement"] == 1 / 3


def test_robustness_uses_canonical_accuracy(table):
    rows = [rec("p", "accept", "accept", conf=1.0), rec("k", "reject", "accept", kind="mutated", parent="p", operator="x", conf=1.0)]
    b = only(metrics.metric_bundle(table(rows)))
    want = (0.40 * 0 + 0.25 * 0 + 0.15 * 1 + 0.10 * (1 - b["calibration_error"])) / 0.9
    assert math.isclose(b["robustness_score"], want)


def test_mae_and_oracle_invariants(table):
    rows = table([rec("a", "accept", "accept", conf=1.0), rec("b", "reject", "reject", cls="invalid", conf=1.0)])
    b = only(metrics.metric_bundle(rows))
    assert b["decision_accuracy"] == 1 and b["calibration_error"] == 0
    assert all(r["mae"] == 0 for r in metrics.dimension_mae(rows).collect())


def test_integrity(table):
    rows = [rec("a", "accept", "accept"), rec("a", "accept", "accept"), rec("m", "accept", "accept", kind="mutated"), rec("n", "accept", "accept", kind="mutated", parent="a", operator="x"), rec("z", "accept", "accept", kind="mutated", parent="zz", operator="x")]
    got = {(r["rule"], r["key"]) for r in integrity.violations(table(rows)).collect()}
    assert got == {("duplicate_key", "a|a|0"), ("missing_link", "m|a|0")}
    assert {r["case_id"] for r in integrity.dangling_parents(table(rows)).collect()} == {"m", "z"}
    with pytest.raises(ValueError):
        integrity.require_none(integrity.duplicate_keys(table(rows)), "duplicate metric record")


def test_repeats(spark, table):
    rows = [rec("u", "accept", "accept", repeat=k, conf=0.5 + k / 10) for k in range(3)] + [rec("f", "accept", "accept" if k else "reject", repeat=k) for k in range(3)] + [rec("i", "accept", "accept", repeat=0)]
    r = only(repeats.repeat_stability(table(rows), 3))
    assert (r["cases_compared"], r["unanimous"], r["flipped"], r["incomplete"]) == (3, 1, 1, 1)
    assert math.isclose(r["unanimity_rate"], 1 / 3) and r["complete_rate"] == 0.5 and math.isclose(r["mean_spread"], 0.1)
    votes = spark.createDataFrame([("p", m, q, a) for m, q, a in (("x", "yes", "no"), ("y", "yes", "no"), ("z", "no", "no"))] + [("h", "x", "yes", "yes")], "pair_id string, model string, quality_changed string, action_changed string")
    got = {r["pair_id"]: (r["category"], r["dissent"]) for r in repeats.vote_majority(votes).collect()}
    assert got == {"p": ("quality_only", True), "h": ("incomplete", False)}


def test_percentiles_and_bootstrap(table):
    assert resample.percentile_indices(2000, 0.95) == (50, 1950)
    with pytest.raises(ValueError):
        resample.percentile_indices(0, 0.95)
    import random

    rows = [(*rec(f"c{k}", "accept", "accept" if k % 3 else "reject", who=w)[:11], k, D, D) for k in range(12) for w in ("a", "b")]
    got = {r["name"]: r for r in resample.cluster_bootstrap(table(rows), resamples=3000, seed=7).collect()}
    rng, values = random.Random(7), []
    for _ in range(3000):
        drawn = [rng.choice(range(12)) for _ in range(12)]
        values.append(sum(1 for d in drawn if d % 3) / 12)
    values.sort()
    assert abs(got["a"]["lo"] - values[75]) <= 1 / 12 and abs(got["a"]["hi"] - values[2925]) <= 1 / 12 and abs(got["a"]["mean"] - 8 / 12) < 0.01
    assert got["b minus a"]["mean"] == 0 and got["a"]["observed"] == 8 / 12
    again = {r["name"]: r for r in resample.cluster_bootstrap(table(rows).repartition(5), resamples=3000, seed=7).collect()}
    assert got == again
    # the generator of other tools, draw by draw
    rng, want = random.Random(7), set()
    for r in range(20):
        want |= {(r, k, m) for k, m in Counter(rng.choice(range(12)) for _ in range(12)).items()}
    assert {tuple(x) for x in resample.draws(table(rows).sparkSession, 12, 20, 7).collect()} == want
    b = {r["evaluator_name"]: r for r in resample.row_bootstrap(table(rows), resamples=200).collect()}
    assert b["a"]["lo"] <= b["a"]["point"] <= b["a"]["hi"]


def test_bootstrap_of_many_clusters_and_groups(spark, monkeypatch):
    """Several blocks: every resample has as many draws as there are clusters; intervals of flips need two groups."""
    monkeypatch.setattr(resample, "BLOCK", 40)
    tallies = spark.range(500).select(F.lit("e").alias("evaluator_name"), F.concat(F.lit("c"), "id").alias("cluster"), (F.col("id") % 4 == 0).cast("long").alias("correct"), F.lit(1).cast("long").alias("cases"))
    sums = resample._sums(tallies, 400, 3).collect()
    assert len(sums) == 400 and {r["cases"] for r in sums} == {500}
    share = [r["correct"] / 500 for r in sums]
    spread = (sum((x - 0.25) ** 2 for x in share) / 400) ** 0.5
    assert abs(sum(share) / 400 - 0.25) < 0.005 and 0.8 < spread / (0.25 * 0.75 / 500) ** 0.5 < 1.2
    flips = spark.createDataFrame([(f"g{k % 5}", int(k % 3 == 0)) for k in range(60)], "group string, flip int")
    r = resample.flip_interval(flips, resamples=500).first()
    assert r["lo"] <= 20 / 60 <= r["hi"]
    assert resample.flip_interval(flips.where("group = 'g1'")).first()["lo"] is None
