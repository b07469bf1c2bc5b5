"""Answers of a classifier head: the order of checks, label maps, sums."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from assay.operators import distributions as d
from assay.schema import DECISIONS, DIMENSIONS

LABELS = d.LabelMap.permuted(3)


def answer(**changes):
    scores = {f"dim_{k}": {"type": "score", "score": 1.5, "probabilities": {"0": 0.1, "1": 0.3, "2": 0.6}} for k in DIMENSIONS}
    decision = {"type": "choice", "choice": LABELS.options[0], "probabilities": dict(zip(LABELS.options, (0.7, 0.2, 0.1))), "confidence": 0.9}
    return {"model": "m-1", "answers": {"decision": decision, **scores}, "usage": {"input_tokens": 7, "cost": True}} | changes


def edited(*path, to=None, drop=False):
    out = json.loads(json.dumps(answer()))
    at = out
    for key in path[:-1]:
        at = at[key]
    if drop:
        del at[path[-1]]
    else:
        at[path[-1]] = to
    return out


P, S = ("answers", "decision", "probabilities"), ("answers", f"dim_{DIMENSIONS[2]}")
CASES = [
    (answer(), None), (None, d.MALFORMED), ([answer()], d.MALFORMED), ("text", d.MALFORMED), (edited("model", drop=True), d.NO_VERSION), (edited("model", to=" \t"), d.NO_VERSION), (edited("model", to=3), d.NO_VERSION),
    (edited("answers", drop=True), d.NO_ANSWER), (edited("answers", to=[]), d.NO_ANSWER), (edited("answers", "decision", to=None), d.NO_ANSWER), (edited("answers", "decision", "type", to="score"), d.NO_ANSWER), (edited("answers", "decision", "choice", to=1), d.NO_ANSWER),
    (edited("answers", "decision", "choice", to="other"), d.UNKNOWN), (edited(*P, "more", to=0.0), d.UNKNOWN), (edited(*P, LABELS.options[1], drop=True), d.BAD), (edited(*P, to=[0.5]), d.BAD), (edited(*P, to=None), d.BAD),
    (edited(*P, LABELS.options[0], to=True), d.BAD), (edited(*P, LABELS.options[0], to="0.7"), d.BAD), (edited(*P, LABELS.options[0], to=-0.1), d.BAD), (edited(*P, LABELS.options[0], to=1.1), d.BAD),
    (edited(*P, LABELS.options[0], to=0.715), None), (edited(*P, LABELS.options[0], to=0.7151), d.BAD), (edited(*P, LABELS.options[0], to=0.685), None), (edited(*P, LABELS.options[0], to=0.684), d.BAD), (edited(*P, to=dict.fromkeys(LABELS.options, 0)), d.BAD),
    (edited(*P, to=dict(zip(LABELS.options, (1, 0, 0)))), None), (edited("answers", "decision", "confidence", to=None), None), (edited("answers", "decision", "confidence", to=1.01), d.BAD), (edited("answers", "decision", "confidence", to="x"), d.BAD),
    (edited(*S, drop=True), d.NO_ANSWER), (edited(*S, "type", to="choice"), d.NO_ANSWER), (edited(*S, "score", to=False), d.NO_ANSWER), (edited(*S, "score", to=2.01), d.BAD), (edited(*S, "score", to=-0.01), d.BAD), (edited(*S, "score", to=2), None),
    (edited(*S, "probabilities", to={"0": 1.0}), d.BAD), (edited(*S, "probabilities", to={"0": 0.2, "1": 0.2, "3": 0.6}), d.UNKNOWN), (edited("usage", to=None), None), (edited("more", to={"x": 1}), None),
]


def test_checks_and_their_order(spark):
    rows = spark.createDataFrame([(k, None if x is None else json.dumps(x), "m") for k, (x, _) in enumerate(CASES)] + [(900, "", "m"), (901, '{"model": 1, "model": 2}', "m"), (902, "{", "m")], "k int, response string, model_version_ string")
    got = {r["k"]: r for r in d.decoded(rows, LABELS).collect()}
    assert {k: got[k]["failure"] for k in range(len(CASES))} == {k: f for k, (_, f) in enumerate(CASES)}
    assert all(got[k]["failure"] == d.MALFORMED and got[k]["decision"] is None for k in (900, 901, 902))
    first = got[0]
    assert first["decision"] == DECISIONS[0] and first["selected_option"] == LABELS.options[0] and first["head_confidence"] == 0.9 and first["selected_probability"] == 0.7
    assert first["decision_probabilities"] == dict(zip(DECISIONS, (0.7, 0.2, 0.1))) and first["dimension_values"] == dict.fromkeys(DIMENSIONS, 0.75)
    assert first["usage"].asDict() == {"input_tokens": 7.0, "output_tokens": None, "cost": None}
    assert d.decoded(rows.limit(0), LABELS).count() == 0


def test_sums_do_not_depend_on_order(spark):
    rng = random.Random(2)
    rows = [[rng.random() / 10 for _ in range(rng.randint(0, 30))] for _ in range(300)] + [[1.0, 1e100, 1.0, -1e100]]
    df = spark.createDataFrame([(k, x, sorted(x)) for k, x in enumerate(rows)], "k int, a array<double>, b array<double>")
    for r in df.select("k", d.exact_sum(F.col("a")).alias("a"), d.exact_sum(F.col("b")).alias("b")).collect():
        assert r["a"] == r["b"] == math.fsum(rows[r["k"]])


def test_label_maps():
    assert d.LabelMap.identity().id == "identity" and d.LabelMap.identity().options == DECISIONS
    for seed in range(20):
        p, t = d.LabelMap.permuted(seed), d.LabelMap.tokens(seed)
        assert p.options != DECISIONS and sorted(p.options) == sorted(DECISIONS) and p == d.LabelMap.permuted(seed)
        assert len(set(t.options)) == 3 and not set(t.options) & set(DECISIONS) and all(len(x) == 6 and x.islower() for x in t.options)
        assert p.id.startswith(f"permutation:seed={seed}:") and len(t.id.split(":")[2]) == 12
    for bad in (("a", "b", "b"), ("a", "b", " c"), ("a", "b", ""), ("a", "b")):
        with pytest.raises(ValueError):
            d.LabelMap("tokens", bad)


def test_sums_are_worked_out_once(spark):
    """A sum for each distribution in the whole plan: lambdas do not repeat it for each probability."""
    rows = spark.createDataFrame([("{}",)], "response string")
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        plan = d.decoded(rows, LABELS)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("aggregate(") == 1 + len(DIMENSIONS)
