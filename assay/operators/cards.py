"""Case cards and what an annotator sees of them: a nested projection that leaves no answer behind, at any depth.

What is dropped follows from the schema when the query is planned, so an answer is never read, and a field that is new in a card is checked before a row is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields that hold answers, wherever they stand.
ANSWERS = ("answer", "answers", "status", "expected_action", "expected_decision", "expected_dimensions", "confidence", "rationale", "ground_truth")
#: What a view has of a card's ``input``, and the note that goes with it.
VISIBLE, NOTE = ("opaque_id", "context", "report", "artifacts", "claims"), "Input view. It holds no answers."


def answer_fields(kind: T.DataType, answers: tuple[str, ...] = ANSWERS, at: str = "") -> list[str]:
    """Paths of the fields of a type that hold answers; [] stands for the elements of an array, {} for the values of a map."""
    if isinstance(kind, T.ArrayType):
        return answer_fields(kind.elementType, answers, f"{at}[]")
    if isinstance(kind, T.MapType):
        return answer_fields(kind.valueType, answers, f"{at}{{}}")
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in ([f"{at}.{f.name}".lstrip(".")] if f.name in answers else answer_fields(f.dataType, answers, f"{at}.{f.name}".lstrip(".")))]
    return []


def _without(column: Column, kind: T.DataType, answers: tuple[str, ...]) -> Column:
    if not answer_fields(kind, answers):
        return column
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _without(x, kind.elementType, answers))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, x: _without(x, kind.valueType, answers))
    kept = [_without(column[f.name], f.dataType, answers).alias(f.name) for f in kind.fields if f.name not in answers]
    return F.when(column.isNotNull(), F.struct(*kept)) if kept else F.lit(None)


def without_answers(table: DataFrame, answers: tuple[str, ...] = ANSWERS) -> DataFrame:
    """``table`` without the fields that hold answers, in columns, structs, arrays and maps of any depth."""
    return table.select(*(_without(F.col(f"`{f.name}`"), f.dataType, answers).alias(f.name) for f in table.schema.fields if f.name not in answers))


def views(cards: DataFrame, answers: tuple[str, ...] = ANSWERS) -> DataFrame:
    """(card_id, schema_version, opaque_id, context, report, artifacts, claims, note) of cards (card_id, schema_version, input, ...)."""
    kinds = {f.name: f.dataType for f in cards.schema["input"].dataType.fields}
    if missing := [c for c in VISIBLE if c not in kinds]:
        raise ValueError(f"the input of a card has no {', '.join(missing)}")
    if cards.where("card_id is null or trim(card_id) = '' or input is null").take(1):
        raise ValueError("a card has an id and an input")
    return cards.select("card_id", "schema_version", *(_without(F.col("input")[c], kinds[c], answers).alias(c) for c in VISIBLE), F.lit(NOTE).alias("note"))


def serialized(shown: DataFrame) -> DataFrame:
    """(card_id, view): views as JSON objects with their keys in order, for whatever hands them out."""
    names = sorted(c for c in shown.columns if c != "card_id")
    return shown.select("card_id", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("view"))
