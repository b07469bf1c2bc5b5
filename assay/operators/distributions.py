"""Typed answers of a classifier head: an option with its distribution and a score with one for each dimension, decoded under a label map.

The head answers in the words of a label map, never in decisions.  Checks run in one order and the first that fails gives the
row's ``failure``; nothing is ever put in place of a missing decision, probability or dimension.  All of it is column expressions on variants;
sums are compensated, so they do not depend on the order of a map, and distributions that miss 1 by rounding alone are scaled to it.

Defined results: null and blank responses, and those that are no JSON object or name a key twice, are malformed; extra keys of answers are ignored, extra
options are unknown; extra columns stay as they are.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import random
import string
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.schema import DECISIONS, DIMENSIONS

# Codes, question names, levels of a dimension, the rounding step of a probability, letters of a token.
MALFORMED, NO_ANSWER, UNKNOWN, BAD, NO_VERSION = (
    "response.malformed", "response.missing_answer", "response.unknown_option", "response.bad_distribution", "response.missing_version",
)
DECISION_QUESTION, DIMENSION_PREFIX, LEVELS, HALF_STEP, TOKEN_LETTERS = "decision", "dim_", 3, 0.005, 6
USAGE = ("input_tokens", "output_tokens", "cost")
_NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


@dataclass(frozen=True)
class LabelMap:
    """The option that stands for each decision, in the order of decisions; ``kind`` is identity, permutation or tokens."""

    kind: str
    options: tuple[str, str, str]
    seed: int | None = None

    def __post_init__(self):
        if len(self.options) != len(DECISIONS) or len(set(self.options)) != len(self.options):
            raise ValueError("a label map has a different option for each decision")
        if any(not isinstance(o, str) or not o or o != o.strip() for o in self.options):
            raise ValueError("options are not empty and not padded")

    @classmethod
    def identity(cls) -> LabelMap:
        return cls("identity", DECISIONS)

    @classmethod
    def permuted(cls, seed: int) -> LabelMap:
        """The names of decisions in another order, drawn by ``seed``."""
        return cls("permutation", random.Random(seed).choice([p for p in itertools.permutations(DECISIONS) if p != DECISIONS]), seed)

    @classmethod
    def tokens(cls, seed: int) -> LabelMap:
        """Words without a meaning, drawn by ``seed``."""
        rng, found = random.Random(seed), []
        while len(found) < len(DECISIONS):
            token = "".join(rng.choice(string.ascii_lowercase) for _ in range(TOKEN_LETTERS))
            if token not in (*DECISIONS, *found):
                found.append(token)
        return cls("tokens", tuple(found), seed)

    @property
    def id(self) -> str:
        if self == LabelMap.identity():
            return "identity"
        pairs = json.dumps([list(x) for x in zip(self.options, DECISIONS)])
        return f"{self.kind}:seed={self.seed}:{hashlib.sha256(pairs.encode()).hexdigest()[:12]}"

    def decision(self, option: Column) -> Column:
        """The decision of an option; NULL for an unknown one."""
        return reduce(lambda c, x: c.when(option == x[0], x[1]), zip(self.options[1:], DECISIONS[1:]), F.when(option == self.options[0], DECISIONS[0]))


def exact_sum(numbers: Column) -> Column:
    """Compensated sum of an array of doubles: what each addition rounds away is carried beside the sum."""

    def add(acc: Column, x: Column) -> Column:
        total = acc.total + x
        lost = F.when(F.abs(acc.total) >= F.abs(x), (acc.total - total) + x).otherwise((x - total) + acc.total)
        return F.struct(total.alias("total"), (acc.lost + lost).alias("lost"))

    return F.aggregate(numbers, F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("lost")), add, lambda acc: acc.total + acc.lost)


def number(value: Column) -> Column:
    """A variant's number; NULL for anything else, truth values among it."""
    return F.when(F.schema_of_variant(value).rlike(_NUMBER), F.try_variant_get(value, "$", "double"))


def text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def member(value: Column, path: str, kind: str = "variant") -> Column:
    """What is at ``path`` of a variant, as ``kind``; NULL where nothing is, or something else. Nothing beside the path is visited or copied."""
    return F.try_variant_get(value, path, kind)


def is_object(value: Column, path: str = "$") -> Column:
    """Whether there is an object at ``path``: nothing else casts to a struct."""
    return member(value, path, "struct<type:variant>").isNotNull()


def members(value: Column, path: str = "$") -> Column:
    """A variant's object as a map; NULL for anything else."""
    return member(value, path, "map<string,variant>")


def numbers_of(values: list[Column]) -> Column:
    return F.transform(F.array(*values), number)


def exact_sum_of(numbers: list[Column]) -> Column:
    """:func:`exact_sum` of a few columns, without lambdas; columns that the sums of the first of them are read from again should be cheap."""
    total, lost = F.lit(0.0) + numbers[0], F.lit(0.0)
    for x in numbers[1:]:
        more = total + x
        total, lost = more, lost + F.when(F.abs(total) >= F.abs(x), (total - more) + x).otherwise((x - more) + total)
    return total + lost


def distribution(odd_keys: Column, keys: tuple[str, ...], numbers: Column, total: Column) -> tuple[Column, Column]:
    """(failure, probabilities) over ``keys``, scaled to a sum of 1; ``odd_keys`` is the failure of a map's keys, ``numbers`` and their sum are columns of their own."""
    each = [F.get(numbers, i) for i in range(len(keys))]
    unit = reduce(and_, (F.coalesce(x.between(0.0, 1.0), F.lit(False)) for x in each))
    near = (total > 0) & (F.abs(total - 1.0) <= HALF_STEP * len(keys) + 1e-9)
    failure = F.when(odd_keys.isNotNull(), odd_keys).when(~unit, BAD).when(~near, BAD)
    return failure, F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.try_divide(x, total) for x in each)))


def _odd_keys(raw: Column, keys: tuple[str, ...]) -> Column:
    """Why a map has not exactly ``keys``, else NULL; one that lacks some has no number there."""
    return F.when(raw.isNull(), BAD).when(F.size(F.array_except(F.map_keys(raw), F.array(*map(F.lit, keys)))) > 0, UNKNOWN)


#: What the text of a value that is no string may begin with or be: where a string is wanted, such a text may have been one, or not.
_MAYBE_NO_STRING = r"^(?:[-0-9\[{]|true$|false$)"
_FAR = 1e300


def _typed(questions: dict[str, tuple[str, tuple[str, ...]]]) -> str:
    """The type that a complete answer is read as at once."""
    inner = {q: f"type:string,probabilities:map<string,double>,{'score:double' if k else 'choice:string,confidence:double'}" for k, (q, _) in questions.items()}
    return "model string, answers struct<" + ",".join(f"`{q}`:struct<{fields}>" for q, fields in inner.items()) + ">"


def _is_plain(text_of: Column, typed: Column, questions: dict[str, tuple[str, tuple[str, ...]]]) -> Column:
    """Whether an object that is read as :func:`_typed` holds all of it, so that nothing of it can have been of another type.

    Numbers are never made of strings but of a few names of numbers that are not finite; a confidence that is NULL is absent where no text names it.
    """
    answers = typed["answers"]
    string = lambda c: c.isNotNull() & ~c.rlike(_MAYBE_NO_STRING)
    finite = lambda c: F.coalesce(c.between(-_FAR, _FAR), F.lit(False))
    decision = answers[DECISION_QUESTION]
    held = [string(typed["model"]), string(decision["choice"]), F.when(decision["confidence"].isNull(), ~F.contains(text_of, F.lit("confidence")) & ~F.contains(text_of, F.lit("\\"))).otherwise(finite(decision["confidence"]))]
    for k, (q, keys) in questions.items():
        given = answers[q]["probabilities"]
        held += [answers[q]["type"].isNotNull(), F.size(given) == len(keys), *(finite(given[key]) for key in keys)] + ([finite(answers[q]["score"])] if k else [])
    return F.coalesce(reduce(and_, held), F.lit(False))


def decoded(responses: DataFrame, labels: LabelMap, column: str = "response") -> DataFrame:
    """``responses`` with model_version, selected_option, decision, selected_probability, head_confidence, decision_probabilities (by decision),
    dimension_scores, dimension_values (score over the highest level), dimension_probabilities, usage, and ``failure``, NULL where all checks hold."""
    # steps as columns: each is named once and read by the next; lambdas keep steps out of whole-stage code, whose methods would be too large to be compiled.
    # An answer that has all of its parts is read at once with their types; parts of the others are looked at one by one, as variants.
    levels = tuple(map(str, range(LEVELS)))
    questions = {"": (DECISION_QUESTION, labels.options), **{f"_{d}": (DIMENSION_PREFIX + d, levels) for d in DIMENSIONS}}
    given = F.col(column).cast("string")
    rows = responses.withColumn("_body", F.try_parse_json(given))
    rows = rows.withColumn("_typed", F.when(F.col("_body").isNotNull() & given.rlike(r"^[ \t\n\r]*\{"), F.from_json(given, _typed(questions))))
    rows = rows.withColumn("_plain", _is_plain(given, F.col("_typed"), questions))
    plain, typed, body, at = F.col("_plain"), F.col("_typed"), F.col("_body"), lambda q, field: f"$.answers.{q}.{field}"
    other = lambda c: F.when(~plain, c)
    rows = rows.withColumns({
        "_texts": other(F.transform(F.array(member(body, "$.model"), member(body, at(DECISION_QUESTION, "choice")), *(member(body, at(q, "type")) for q, _ in questions.values())), text)),
        "_confident": other(member(body, at(DECISION_QUESTION, "confidence"))), "_scores": other(numbers_of([member(body, at(DIMENSION_PREFIX + d, "score")) for d in DIMENSIONS])),
        **{f"_{u}": number(member(body, f"$.usage.{u}")) for u in USAGE}, "_object": plain | is_object(body), "_answered": plain | is_object(body, "$.answers"),
        **{f"_given{k}": other(members(body, at(q, "probabilities"))) for k, (q, _) in questions.items()},
    })
    either = lambda own, slow: F.when(plain, own).otherwise(slow)
    decision = typed["answers"][DECISION_QUESTION]
    rows = rows.withColumns({
        "_version": either(typed["model"], F.col("_texts")[0]), "_choice": either(decision["choice"], F.col("_texts")[1]),
        "_said": either(decision["confidence"].isNotNull(), F.coalesce(F.schema_of_variant("_confident"), F.lit("VOID")) != "VOID"), "_confidence": either(decision["confidence"], number(F.col("_confident"))),
        **{f"_kind{k}": either(typed["answers"][q]["type"], F.col("_texts")[2 + i]) for i, (k, (q, _)) in enumerate(questions.items())},
        **{f"_score_{d}": either(typed["answers"][DIMENSION_PREFIX + d]["score"], F.col("_scores")[i]) for i, d in enumerate(DIMENSIONS)},
        **{f"_numbers{k}": either(F.array(*(typed["answers"][q]["probabilities"][key] for key in keys)), numbers_of([F.col(f"_given{k}")[key] for key in keys])) for k, (q, keys) in questions.items()},
        **{f"_keys{k}": other(_odd_keys(F.col(f"_given{k}"), keys)) for k, (_, keys) in questions.items()},
    })
    rows = rows.withColumns({f"_total{k}": either(exact_sum_of([F.get(F.col(f"_numbers{k}"), i) for i in range(len(keys))]), exact_sum(F.col(f"_numbers{k}"))) for k, (_, keys) in questions.items()})
    found = {k: distribution(F.col(f"_keys{k}"), keys, F.col(f"_numbers{k}"), F.col(f"_total{k}")) for k, (_, keys) in questions.items()}
    of_type = lambda k, kind: F.coalesce(F.col(f"_kind{k}") == kind, F.lit(False))
    wrong = {"": F.coalesce(
        F.when(~F.coalesce("_object", F.lit(False)), MALFORMED), F.when(~F.coalesce("_version", F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]"), NO_VERSION), F.when(~F.coalesce("_answered", F.lit(False)), NO_ANSWER),
        F.when(~of_type("", "choice") | F.col("_choice").isNull(), NO_ANSWER), F.when(labels.decision(F.col("_choice")).isNull(), UNKNOWN),
        found[""][0], F.when(F.col("_said") & ~F.coalesce(F.col("_confidence").between(0.0, 1.0), F.lit(False)), BAD),
    )}
    for d in DIMENSIONS:
        wrong[f"_{d}"] = F.coalesce(F.when(~of_type(f"_{d}", "score") | F.col(f"_score_{d}").isNull(), NO_ANSWER), F.when(~F.col(f"_score_{d}").between(0.0, LEVELS - 1.0), BAD), found[f"_{d}"][0])
    # a column for each question, made where the sums are, as a lambda would work out its checks without compiled code
    rows = rows.withColumns({f"_wrong{k}": w for k, w in wrong.items()} | {f"_spread{k}": spread for k, (_, spread) in found.items()})
    rows = rows.withColumn("failure", F.coalesce(*(F.col(f"_wrong{k}") for k in questions)))

    by_dimension = lambda made: F.map_from_arrays(F.array(*map(F.lit, DIMENSIONS)), F.array(*map(made, DIMENSIONS)))
    out = {
        "model_version": F.col("_version"), "selected_option": F.col("_choice"), "decision": labels.decision(F.col("_choice")), "selected_probability": F.col("_spread")[F.col("_choice")], "head_confidence": F.col("_confidence"),
        "decision_probabilities": F.map_from_arrays(F.array(*map(F.lit, DECISIONS)), F.array(*(F.col("_spread")[o] for o in labels.options))),
        "dimension_scores": by_dimension(lambda d: F.col(f"_score_{d}")), "dimension_values": by_dimension(lambda d: F.col(f"_score_{d}") / (LEVELS - 1)),
        "dimension_probabilities": by_dimension(lambda d: F.col(f"_spread_{d}")), "usage": F.struct(*(F.col(f"_{u}").alias(u) for u in USAGE)),
    }
    fine = F.col("failure").isNull()
    return rows.select(*responses.columns, *(F.when(fine, c).alias(k) for k, c in out.items()), "failure")
