"""Denials and their conditions: sentences from a small grammar whose parts say what they must be read as."""

import itertools
import time

from pyspark.sql import functions as F

from assay.functions import denials as D
from assay.operators.evaluators import boundary_denials

DENIALS = ("no security boundary applies", "no security boundary between guests is crossed", "no boundary of the shop v2.0 is crossed")
CONDITIONS = ("if the cache is cold", "whether the N.Z. Post office is open", "unless (as told) the queue is full", "when the clerk, a guest, logs in")
#: What stands before a leading condition; what joins it with a denial; what stands around both.
BEFORE = ("", "Only ", "And ", "But only ", "Note: ", "Depending directly on ", "It depends upon ", "- ", "> ", "3) ", "- [x] ", "**", '"')
JOINED = (", ", " then ", " — ", " -- ")
#: What may stand between a denial and the condition behind it, and what may not.
DIRECT = (" ", " only ", ", even ", " — ", " -- only ", ", depending on ", " to every visitor ", " (", " (especially ")
APART = ("; write to us ", ", but write to us ", ", however write to us ", ", and write to us ", ". Write to us ", "! Write to us ", " — write to us ", " (write to us ", " because they ask ", "\n\nWrite to us ", "\n- Write to us ", " to the ", " to the word ")
#: Ends of a sentence that lies before a denial.
ENDS = (". ", "? ", "! ", "; ", "\n\n", "\n- ", "\n> ", ". **", '." ', ". (")


def sentence(text):
    return text[:1].upper() + text[1:]


def cases():
    for before, (condition, joined), denial in itertools.product(BEFORE, itertools.product(CONDITIONS, JOINED), DENIALS):
        lead = before + (condition if before.rstrip(" -*>)\"[]x3") else sentence(condition))
        yield f"Fine so far. \n\n{lead}{joined}{denial}.", (False, True)
    for denial, between, condition in itertools.product(DENIALS, DIRECT, CONDITIONS[:2]):
        yield f"{sentence(denial)}{between}{condition}{')' if '(' in between else ''}.", (False, True)
    for denial, between, condition in itertools.product(DENIALS, APART, CONDITIONS[:2]):
        yield f"{sentence(denial)}{between}{condition}.", (True, False)
    for condition, end, denial in itertools.product(CONDITIONS, ENDS, DENIALS):
        yield f"{sentence(condition)}, write to us{end}{sentence(denial)}.", (True, False)
    for denial, other in itertools.product(DENIALS, DENIALS):
        yield f"{sentence(denial)}. If the cache is cold, {other}.", (True, True)
        yield f"{sentence(denial)}. {sentence(other)} (if the cache is cold).", (True, True)
        yield f"{sentence(denial)}! {sentence(other)}?\nWrite to us, if you like.", (True, False)
        yield f"We know (if the cache is cold) that {denial}, and {other}.", (True, False)
    yield from (("", (False, False)), (None, (False, False)), ("If nothing is denied, all is well.", (False, False)), ("Guests use the N.Z. No security boundary applies.", (True, False)), ("If the N.Z. Post office is open: no security boundary applies.", (False, True)))
    yield "If the cache is cold, write to the N.Z. No security boundary applies.", (True, False)


def test_grammar(spark):
    told = list(cases())
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(told)], "k int, raw_text string").repartition(4)
    got = {r["k"]: (r["d"]["outright"], r["d"]["conditional"]) for r in rows.select("k", boundary_denials().alias("d")).collect()}
    wrong = [(t, want, got[k]) for k, (t, want) in enumerate(told) if got[k] != want]
    assert not wrong, (len(wrong), len(told), wrong[:: max(1, len(wrong) // 12)])


def test_cost_grows_with_length(spark):
    def seconds(unit, n):
        rows = spark.createDataFrame([((unit * n)[:n] + " no security boundary applies",)], "raw_text string")
        began = time.perf_counter()
        rows.select(boundary_denials().alias("d")).collect()
        return time.perf_counter() - began

    for unit in ("no boundary between things ", "no boundary ", "if no security boundary (", "if if ( ) , -- ", "*", ". *_~", ".*", "> ", "A.B. ", "\n ", "- [ "):
        seconds(unit, 1000)
        # twenty times as long, and not hundreds of times as much work
        assert seconds(unit, 400_000) < 60 * max(seconds(unit, 20_000), 0.5)


def test_marks_are_few(spark):
    text = "A long sentence of plain words that go on and on. " * 50 + "No security boundary applies."
    row = spark.createDataFrame([(text,)], "t string").select(D.marks(F.col("t"), ("no security boundary",)).alias("m")).first()
    assert len(row["m"]) < 300 and D.DENIAL in row["m"] and D.APPLIES in row["m"]
