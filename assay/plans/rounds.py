"""Line items of an order as attempts of a slot, in rounds, with plans that fit or do not fit the history before them; and what is wrong, in SQL.

What is wrong follows from the items: quantities, taxes and discounts of an order's first line decide how its plan was made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.operators.supplements import round_digests, slot_digests
from assay.plans.bindings import read
from assay.storage import dealt


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slot, round, attempt, status, tax, first_tax, first_quantity, first_discount, n): two attempts in the base, three in the first supplement, the others in the second."""
    lines = read(spark, sf_dir, "lineitem")
    items = dealt(lines, lines.count(), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_returnflag").alias("flag"), F.min("l_quantity").alias("q"), F.round(F.min("l_tax") * 100).cast("int").alias("tax"), F.round(F.min("l_discount") * 100).cast("int").alias("d"),
    )
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    rows = items.withColumns({"r": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("l_orderkey"))})
    first = {name: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for name, c in (("first_tax", "tax"), ("first_quantity", "q"), ("first_discount", "d"))}
    status = F.when(F.col("q") == 50, "odd").when(F.col("flag") == "A", "success").when(F.col("flag") == "N", "http_error").otherwise("invalid_or_transport_error")
    return rows.withColumns(first).select(
        F.col("l_orderkey").alias("slot"), F.when(F.col("r") <= 2, 0).when(F.col("r") <= 5, 1).otherwise(2).alias("round"), (F.col("r") + F.when(F.col("d") == 10, 100).otherwise(0)).alias("attempt"), status.alias("status"), "r", "tax", *first, "n",
    )


OWN = ("slot", "round", "attempt", "status", "tax")


def plan(rows: DataFrame) -> DataFrame:
    """(slot, round, previous_attempts, prior_digest): made on a history whose first status was another where the first tax is 0, with a wrong number where it is 8."""
    told = F.when((F.col("r") == 1) & (F.col("first_tax") == 0), "http_error").otherwise(F.col("status"))
    out = None
    for k, before in ((1, 2), (2, 5)):
        past = rows.where(F.col("round") < k).withColumn("status", told).select(*OWN)
        slots = rows.where((F.col("round") == k) & (F.col("first_quantity") <= 45)).groupBy("slot").agg(F.first("first_tax").alias("t"), F.first("first_discount").alias("d"))
        copies = F.when((F.col("d") == 9) & F.lit(k == 1), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        one = slots.join(slot_digests(past), "slot").withColumn("copy", F.explode(copies))
        one = one.select("slot", F.lit(k).alias("round"), (F.lit(before) + F.when(F.col("t") == 8, 1).otherwise(0)).cast("long").alias("previous_attempts"), F.col("digest").alias("prior_digest"))
        out = one if out is None else out.unionByName(one)
    lone = rows.where("n = 1").select((-F.col("slot")).alias("slot"), F.lit(1).alias("round"), F.lit(0).cast("long").alias("previous_attempts"), F.lit(None).cast("string").alias("prior_digest"))
    return out.unionByName(lone)


def protocols(rows: DataFrame, planned: DataFrame, cap: int) -> DataFrame:
    """(round, prior_digest, max_requests): the second one was made before the first supplement ran."""
    past = round_digests(rows.select(*OWN)).where("round > 0")
    slots = planned.groupBy("round").agg((F.countDistinct("slot") * cap).alias("max_requests"))
    digest = F.when(F.col("round") == 1, F.col("digest")).otherwise(F.lit("of an earlier day"))
    return past.join(slots, "round").select("round", digest.alias("prior_digest"), "max_requests")


SQL = """
WITH i AS (SELECT l_orderkey AS k, l_linenumber AS l, min(l_returnflag) AS flag, min(l_quantity) AS q, CAST(round(min(l_tax) * 100) AS INTEGER) AS t, CAST(round(min(l_discount) * 100) AS INTEGER) AS d FROM lineitem GROUP BY ALL),
a AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY k) AS n, first(t) OVER w AS t1, first(q) OVER w AS q1, first(d) OVER w AS d1,
  CASE WHEN q = 50 THEN 'odd' WHEN flag = 'A' THEN 'success' WHEN flag = 'N' THEN 'http_error' ELSE 'invalid_or_transport_error' END AS status FROM i WINDOW w AS (PARTITION BY k ORDER BY l)),
b AS (SELECT *, CASE WHEN r <= 2 THEN 0 WHEN r <= 5 THEN 1 ELSE 2 END AS round, r + CASE WHEN d = 10 THEN 100 ELSE 0 END AS attempt FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round, attempt) AS pos, row_number() OVER (PARTITION BY k, round ORDER BY attempt) AS own,
  coalesce(max(CAST(status = 'success' AS INTEGER)) OVER (PARTITION BY k ORDER BY round, attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS won FROM b),
p AS (SELECT k, m.round, q1, t1, d1, max(CAST(c.status = 'success' AS INTEGER)) AS won, max(CAST(c.r = 1 AND t1 = 0 AND c.status <> 'http_error' AS INTEGER)) AS other, count(*) AS past, n
  FROM c JOIN (SELECT unnest([1, 2]) AS round) m ON c.round < m.round WHERE n > CASE m.round WHEN 1 THEN 2 ELSE 5 END AND q1 <= 45 GROUP BY ALL),
problems AS (
  SELECT k AS slot, round, unnest(list_filter([CASE WHEN won = 1 THEN 'after_success' END, CASE WHEN attempt <> pos THEN 'attempt' END, CASE WHEN round > 0 AND own > 2 THEN 'over_cap' END, CASE WHEN status = 'odd' THEN 'status' END,
    CASE WHEN round > 0 AND q1 > 45 THEN 'unplanned' END], lambda x: x IS NOT NULL)) AS problem FROM c
  UNION ALL SELECT k, round, 'changed_history' FROM p, (SELECT unnest([1, 2]) AS copy) WHERE (copy = 1 OR (round = 1 AND d1 = 9)) AND (won = 1 OR t1 = 8 OR other = 1)
  UNION ALL SELECT k, round, 'repeated_plan' FROM p WHERE round = 1 AND d1 = 9
  UNION ALL SELECT -k, 1, 'unknown_slot' FROM c WHERE n = 1)
"""
