"""Figures of large tables: what must be read, parsed or made once only."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assay.operators import analysis, distributions, ledgers, metrics, mutations
from assay.plans import heads
from assay.schema import DIMENSIONS


def _plan(df, part="optimizedPlan"):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", 5000)
    try:
        return str(getattr(df._jdf.queryExecution(), part)())
    finally:
        df.sparkSession.conf.unset("spark.sql.debug.maxToStringFields")


def _accounts(records, failures, index):
    """Slots one by one; a case without an id is counted as planned, but is nobody's."""
    known, out = set(index), {}
    scored, failed = Counter(records), Counter(failures)
    for name in {e for e, _ in [*scored, *failed]}:
        slots = {c for e, c in [*scored, *failed] if e == name}
        s, f = ({c for c in slots if t[name, c]} for t in (scored, failed))
        here = {c for c in slots if c is not None and c in known}
        repeated = sum(scored[name, c] > 1 or failed[name, c] > 1 for c in slots)
        row = (len(known), len(s), len(f), len(s & f), len(known) - len(here), len(slots - here), repeated)
        out[name] = (*row, not any(row[3:]) and row[0] == row[1] + row[2])
    return out


@pytest.mark.parametrize("evaluators", [2, 7])
def test_accounts_are_made_in_one_grouping(spark, evaluators):
    """cases are grouped once, with the counts of all evaluators, and joined with nothing."""
    rng = random.Random(evaluators)
    names = [*(f"e{k}" for k in range(evaluators)), None]
    cases = [*(f"c{k}" for k in range(30)), None]
    some = lambda n: [(rng.choice(names), rng.choice(cases)) for _ in range(n)]
    records, failures, index = some(8 * evaluators) + [("whole", c) for c in cases[:20]], some(evaluators) + [("only failed", "c1")], [*cases[:20], "c3", "c4"]
    table = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    for planned in (index, [*index, None], []):
        given = (table(records, "evaluator_name string, case_id string"), table(failures, "evaluator_name string, case_id string"), table([(c,) for c in planned], "case_id string"))
        want = _accounts(records, failures, planned)
        for known in (None, {*names, "whole", "only failed", "absent"}):
            out = ledgers.accounting(*given, known)
            assert {r[0]: tuple(r)[1:] for r in out.collect()} == want
    if evaluators == 2:
        assert "Join" not in _plan(out)
    none = table([], "evaluator_name string, case_id string")
    assert ledgers.accounting(none, none, given[2]).count() == 0


def test_digests_are_read_in_four_parts(spark):
    """the halves of a digest are those of its hex digits, and each part is read once."""
    digests = ["f" * 64, "0" * 64, "8" + "0" * 63, "7fffffffffffffff" * 4, *(f"{random.Random(k).getrandbits(256):064x}" for k in range(20))]
    halves = analysis.digest_halves(F.col("h"))
    assert sum(str(c).count("conv(") for c in halves.values()) <= 8
    rows = spark.createDataFrame([(d,) for d in digests], "h string")
    for r in rows.select("h", *(c.alias(k) for k, c in halves.items())).collect():
        assert [r[f"_p{k}"] for k in range(8)] == [int(r["h"][8 * k:8 * k + 8], 16) for k in range(8)]
    # each distinct part is read once: four in the whole table
    assert len({str(c).split("conv(")[1].split(", 16, -10")[0] for c in halves.values()}) == 4


DDL = "case_id string, case_kind string, parent_id string, operator string, report_class string, expected_decision string, evaluator_name string, decision string, confidence double, repeat_index int"


def test_a_bundle_counts_rows_by_what_they_meet(spark):
    """rows go into one sum by what they meet, not into sums for each metric and bin, and the metrics are those that are made one by one."""
    rng, rows = random.Random(4), []
    for k in range(300):
        kind, expected, decided = rng.choice(("canonical", "mutated")), rng.choice(("accept", "reject", "needs_manual_review", None)), rng.choice(("accept", "reject", "needs_manual_review"))
        parent = None if kind == "canonical" else rng.choice(("c1", "c2", "c3", "none", None))
        confidence = rng.choice((0.0, 0.1, 0.3, 0.7, 0.95, 1.0, 1.5, -0.5, float("nan"), None))
        rows.append((f"c{k}", kind, parent, rng.choice((None, "professionalize_style", "scope_expansion")), rng.choice(("valid", "invalid", "review")), expected, rng.choice(("x", "y", None)), decided, confidence, 0))
    rows += [(f"c{k}", "canonical", None, None, "valid", "reject", e, "accept", 0.5, 0) for e in ("x", "y") for k in (1, 2, 3)]
    records = spark.createDataFrame(list({(r[0], r[6]): r for r in rows}.values()), DDL)
    bundle = {r["evaluator_name"]: r.asDict() for r in metrics.metric_bundle(records).collect()}
    for made, its, name in (
        (metrics.decision_accuracy, "decision_accuracy", "decision_accuracy"), (metrics.false_reassurance, "false_reassurance_rate", "false_reassurance_rate"), (metrics.over_rejection, "over_rejection_rate", "over_rejection_rate"),
        (metrics.changing_target_accuracy, "target_accuracy", "target_accuracy"), (metrics.preserving_drift, "drift", "drift"), (metrics.presentation_susceptibility, "susceptibility", "susceptibility"),
        (metrics.decision_accuracy, "total_cases", "total_cases"), (metrics.decision_accuracy, "correct_cases", "correct_cases"),
    ):
        assert {r["evaluator_name"]: r[its] for r in made(records).collect()} == {k: r[name] for k, r in bundle.items()}, name
    assert {r["evaluator_name"]: r["calibration_error"] for r in metrics.calibration_error(records).collect() if r["evaluator_name"]} == {k: pytest.approx(r["calibration_error"]) for k, r in bundle.items() if k}
    big = next(line for line in _plan(metrics._kinds(records, ("evaluator_name",))).split("\n") if "Aggregate" in line)
    assert big.count("sum(") == 1 and big.count("count(") == 1


def _answers():
    from test_distributions import CASES, LABELS

    made = [json.dumps(x) for x, _ in CASES if x is not None] + ["", "{", '{"model": 1, "model": 2}', "[1]", None]
    good = CASES[0][0]
    whole = json.dumps(good)
    change = lambda old, new: whole.replace(old, new, 1)
    made += [
        " \n" + whole, change('"m-1"', '"7"'), change('"m-1"', "7"), change('"m-1"', '"NaN"'), change('"m-1"', '" "'), change("0.7", '"NaN"'), change("0.7", "7e-1"), change("0.7", "1e999"), change("0.7", "0"), change("0.7", '"Infinity"'),
        change('"confidence": 0.9', '"confidence": "0.9"'), change('"confidence": 0.9', '"confidence": null'), change('"confidence": 0.9', '"more": 0.9'), change('"confidence": 0.9', '"confidenc\\u0065": []'), change('"confidence": 0.9', '"confidence": 1e400'),
        change('"type": "choice"', '"type": null'), change('"type": "score"', '"type": ["score"]'), change(f'"{LABELS.options[0]}"', "3"), change("1.5", '"1.5"'), change("1.5", "true"), change("1.5", "123456789012345678901234567890"), change("0.1, ", '{"x": 1}, '),
        change('"input_tokens": 7', '"input_tokens": "7"'), change('"input_tokens": 7', '"input_tokens": 1.5e3'), change('"usage"', '"usage": {}, "other"'), whole + " x", change('"0": 0.1', '"0": 0.1, "0": 0.1'), change('"0": 0.1', '"0": true, "9": 0'),
    ]
    return made, LABELS


def test_whole_answers_are_read_at_once(spark, monkeypatch):
    """an answer that has all of its parts is read with their types at once, and any answer gives what it gives part by part."""
    made, labels = _answers()
    rows = spark.createDataFrame(list(enumerate(made)), "k int, response string").repartition(1)
    plain = lambda: {r["k"]: r for r in distributions.decoded(rows, labels).collect()}
    got = plain()
    seen = []
    monkeypatch.setattr(distributions, "_is_plain", lambda *x, f=distributions._is_plain: seen.append(x) or F.lit(False))
    slow = plain()
    assert seen and {k: r.asDict(True) for k, r in got.items()} == {k: r.asDict(True) for k, r in slow.items()}


def test_a_good_answer_is_no_variant_but_for_its_keys(spark):
    """nothing of a whole answer is looked at as a variant."""
    made, labels = _answers()
    questions = {"": (distributions.DECISION_QUESTION, labels.options), **{f"_{d}": (distributions.DIMENSION_PREFIX + d, ("0", "1", "2")) for d in DIMENSIONS}}
    rows = spark.createDataFrame([(made[0],), (made[0].replace('"confidence": 0.9', '"more": 0.9'),), (made[0].replace("0.7", '"0.7"'),)], "t string").repartition(1)
    typed = rows.withColumn("x", F.from_json("t", distributions._typed(questions)))
    assert sorted(r["p"] for r in typed.select(distributions._is_plain(F.col("t"), F.col("x"), questions).alias("p")).collect()) == [False, True, True]


def test_hundredths_without_quotients(spark):
    """hundredths are written as before, and no decimals are divided."""
    rows = spark.createDataFrame([(k,) for k in (-123, -7, 0, 3, 50, 105, 99_999)], "k long")
    got = [r["h"] for r in rows.select(heads._hundredths(F.col("k")).alias("h")).collect()]
    assert got == ["-1.23", "-0.07", "0.00", "0.03", "0.50", "1.05", "999.99"] and "/" not in str(heads._hundredths(F.col("k")))


def test_phrases_are_looked_for_by_their_letters(monkeypatch):
    """an expression runs only on parts that have its letters, and texts come out as if it ran on all."""
    odd = [chr(c) for c in range(128, 0x110000) if re.fullmatch("[a-z]", chr(c), re.I)]
    assert set(odd) <= set(mutations._OTHER_LETTERS)
    every = (*mutations.STYLE, *mutations.CERTAINTY)
    assert all(p.needle and p.needle == p.needle.lower() for p in every)
    rng, words = random.Random(5), [p.needle for p in every] + ["the", "it", "\n```\n", "\n", "#", "é", "Report"]
    turned = str.maketrans("ksi", "Kſİ")
    texts = [" ".join(rng.choice((str, str.upper, str.capitalize, lambda w: w.translate(turned)))(rng.choice(words)) for _ in range(60)) for _ in range(200)]
    made = lambda: [mutations.rewritten(t, phrases, once) for t in texts for phrases, once in ((mutations.STYLE, False), (mutations.CERTAINTY, True), (mutations.STARTS, False))]
    fast, ran = made(), []
    blunt = lambda ps: tuple(mutations.Phrase(p.pattern, p.say, p.tag) for p in ps)
    monkeypatch.setattr(mutations, "STYLE", blunt(mutations.STYLE))
    monkeypatch.setattr(mutations, "CERTAINTY", blunt(mutations.CERTAINTY))
    assert made() == fast

    plain = re.compile(r"(?m)^[^\S\n]*[^\W\d_]")
    starts, lines = mutations.STARTS[0], [*texts, "", "\n", " \n\ta b\n\n1 c\n\r d", "\u2028é\n_x\n\x1f y", "a\n"]
    assert [starts.pattern.subn(starts.say, t, count=n) for t in lines for n in (0, 1)] == [plain.subn(starts.say, t, count=n) for t in lines for n in (0, 1)]

    class Seen:
        def subn(self, say, part, count=0):
            ran.append(part)
            return part, 0

    mutations.rewritten("nothing of it is here", (mutations.Phrase(Seen(), str, needle="bypass"), mutations.Phrase(Seen(), str, needle="here")))
    assert len(ran) == 1
