"""Answers of a classifier head made of the numbers of line items, with what they decode to, in SQL.

Probabilities, scores and confidences are quantities, discounts, taxes and prices in hundredths, so which answers have a bad sum, a
score out of range or no version follows from the table's values.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators.distributions import DIMENSION_PREFIX, LabelMap
from assay.plans.bindings import read
from assay.schema import DECISIONS, DIMENSIONS

LABELS = LabelMap.tokens(11)


def _hundredths(c: Column) -> Column:
    """A whole number of hundredths with two decimals; a product of decimals costs a fraction of a quotient."""
    return (c.cast("decimal(10,0)") * F.lit(Decimal("0.01"))).cast("string")


def _spread(names: tuple[str, ...], parts: list[Column]) -> Column:
    keys = F.array(*(F.lit(f'"{n}":') for n in names))  # a lambda keeps this out of whole-stage code, whose method would be too large to be compiled
    inner = F.array_join(F.transform(F.array(*parts), lambda p, i: F.concat(F.get(keys, i), _hundredths(p))), ",")
    return F.concat(F.lit("{"), inner, F.lit("}"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, line, response): an answer for every line item."""
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag", "l_linestatus")))
    whole = lambda c: F.floor(c).cast("long")
    rows = items.select(
        F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), whole(F.col("l_quantity")).alias("q"), F.round(F.col("l_discount") * 100).cast("long").alias("d"),
        F.round(F.col("l_tax") * 100).cast("long").alias("t"), whole(F.col("l_extendedprice")).alias("x"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )
    first = 2 * F.col("q")
    second = F.floor((100 - first) * F.col("d") / 10).cast("long")
    third = 96 - first - second + F.col("t")
    option = F.when(F.col("q") == 50, "other").when(F.col("flag") == "A", LABELS.options[0]).when(F.col("flag") == "N", LABELS.options[1]).otherwise(LABELS.options[2])
    parts = [
        F.concat(F.lit('{"answers":{"decision":{"type":"'), F.when(F.col("q") == 7, "score").otherwise("choice"), F.lit('","choice":"'), option, F.lit('","probabilities":'), _spread(LABELS.options, [first, second, third])),
        F.when(F.col("d") > 0, F.concat(F.lit(',"confidence":'), _hundredths(15 * F.col("t")))).otherwise(""), F.lit("}"),
    ]
    for i, name in enumerate(DIMENSIONS, 1):
        score = F.floor(F.col("x") * i / 7).cast("long") % 203
        high = F.floor(score / 2).cast("long")
        low = F.floor((100 - high) * F.col("d") / 10).cast("long")
        parts.append(F.concat(F.lit(f',"{DIMENSION_PREFIX}{name}":{{"type":"score","score":'), _hundredths(score), F.lit(',"probabilities":'), _spread(("0", "1", "2"), [low, 100 - high - low, high]), F.lit("}")))
    version = F.when((F.col("d") == 0) & (F.col("t") == 0), " ").otherwise("head-1.2")
    body = F.concat(*parts, F.lit('},"usage":{"input_tokens":'), F.col("x").cast("string"), F.lit(',"cost":"none"},"model":"'), version, F.lit('"}'))
    return rows.select("order", "line", F.when((F.col("q") == 1) & (F.col("status") == "F"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body).alias("response"))


def _decoded_sql() -> str:
    option = f"CASE WHEN q = 50 THEN 'other' WHEN flag = 'A' THEN '{LABELS.options[0]}' WHEN flag = 'N' THEN '{LABELS.options[1]}' ELSE '{LABELS.options[2]}' END"
    scores = ", ".join(f"CAST(floor(x * {i} / 7.0) AS BIGINT) % 203 AS s{i}" for i in range(1, 6))
    over = " OR ".join(f"s{i} > 200" for i in range(1, 6))
    return f"""
WITH i AS (SELECT l_orderkey AS "order", l_linenumber AS line, CAST(floor(min(l_quantity)) AS BIGINT) AS q, CAST(round(min(l_discount) * 100) AS BIGINT) AS d, CAST(round(min(l_tax) * 100) AS BIGINT) AS t,
  CAST(floor(min(l_extendedprice)) AS BIGINT) AS x, min(l_returnflag) AS flag, min(l_linestatus) AS status FROM lineitem GROUP BY ALL),
p AS (SELECT *, 2 * q AS p1, ((100 - 2 * q) * d) // 10 AS p2, {option} AS option, {scores} FROM i),
s AS (SELECT *, 96 - p1 - p2 + t AS p3, 96 + t AS total FROM p),
f AS (SELECT *, CASE WHEN q = 1 AND status = 'F' THEN 'response.malformed' WHEN d = 0 AND t = 0 THEN 'response.missing_version' WHEN q = 7 THEN 'response.missing_answer' WHEN option = 'other' THEN 'response.unknown_option'
  WHEN p3 < 0 OR abs(t - 4) > 1 OR (d > 0 AND 15 * t > 100) OR {over} THEN 'response.bad_distribution' END AS failure FROM s)
"""


DECODED = _decoded_sql()
CHOSEN = f"CASE option WHEN '{LABELS.options[0]}' THEN '{DECISIONS[0]}' WHEN '{LABELS.options[1]}' THEN '{DECISIONS[1]}' ELSE '{DECISIONS[2]}' END"
