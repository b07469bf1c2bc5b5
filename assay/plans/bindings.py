"""The driver tables read as evaluation data, so that every operator runs on them.

orders are canonical reports, line items their mutated children, by two evaluators
``alpha`` and ``beta``; events are outcomes of repeated runs.  Line items are made
unique by (order, line) with the least value of every column.  All rows of the tables take part; so that there are
orphans and odd pairs, some rows name a parent or pair that does not exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.schema import DIMENSIONS, class_default, is_correct
from assay.storage import dealt, scratch  # noqa: F401  queries name their folders through the bindings

OPERATORS = (
    "professionalize_language", "professionalize_style", "confidence_overstatement", "remove_reproduction_step",
    "impossible_precondition", "scope_expansion", "add_irrelevant_detail",
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dims(seed: str) -> F.Column:
    """Five values k/10 from a whole number."""
    values = [F.pmod(F.expr(seed) + k, F.lit(11)) / F.lit(10.0) for k in range(len(DIMENSIONS))]
    return F.map_from_arrays(F.array(*map(F.lit, DIMENSIONS)), F.array(*values))


def _both(rows: DataFrame, alpha: tuple, beta: tuple) -> DataFrame:
    """Each row once for each evaluator, with its (decision, tenths of confidence)."""
    sides = [F.struct(F.lit(name).alias("evaluator_name"), d.alias("decision"), (c / F.lit(10.0)).alias("confidence")) for name, (d, c) in (("alpha", alpha), ("beta", beta))]
    return rows.withColumn("e", F.explode(F.array(*sides))).select("*", "e.*").drop("e")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).alias("level"),
        F.when(F.col("o_orderstatus") == "F", "valid").when(F.col("o_orderstatus") == "O", "invalid").otherwise("review").alias("report_class"),
    )
    parents = orders.select(
        F.concat(F.lit("o"), "o_orderkey").alias("case_id"), F.lit("canonical").alias("case_kind"), F.lit(None).cast("string").alias("parent_id"),
        F.lit(None).cast("string").alias("operator"), "report_class", class_default("report_class").alias("target"), F.col("o_orderkey").alias("key"),
        _dims("o_custkey").alias("expected_dimensions"), _dims("o_orderkey").alias("dimensions"), "level", "o_custkey",
    )
    parents = _both(
        parents,
        (F.when(F.col("level").isin("1", "2"), "accept").when(F.col("level") == "3", "needs_manual_review").otherwise("reject"), F.col("o_custkey") % 11),
        (F.when(F.col("o_custkey") % 3 == 0, "accept").when(F.col("o_custkey") % 3 == 1, "reject").otherwise("needs_manual_review"), F.col("key") % 11),
    ).drop("level", "o_custkey")
    lines = read(spark, sf_dir, "lineitem")
    items = dealt(lines, lines.count(), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(
        *(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus")),
    ).join(orders.select("o_orderkey", "report_class"), F.col("l_orderkey") == F.col("o_orderkey"))
    operator = F.element_at(F.array(*map(F.lit, OPERATORS)), F.col("l_linenumber").cast("int"))
    valid = F.col("report_class") == "valid"
    target = (
        F.when(F.col("operator") == "impossible_precondition", "reject")
        .when(valid & F.col("operator").isin("remove_reproduction_step", "scope_expansion"), "needs_manual_review").otherwise(class_default("report_class"))
    )
    items = items.withColumn("operator", operator)
    children = items.select(
        F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber").alias("case_id"), F.lit("mutated").alias("case_kind"),
        F.concat(F.when(F.col("l_orderkey") % 10 == 0, "x").otherwise("o"), "l_orderkey").alias("parent_id"), "operator", "report_class", target.alias("target"), F.col("l_orderkey").alias("key"),
        _dims("l_partkey").alias("expected_dimensions"), _dims("3 * l_suppkey").alias("dimensions"), "l_returnflag", "l_linestatus", "l_discount", "l_tax",
    )
    children = _both(
        children,
        (F.when(F.col("l_returnflag") == "A", "accept").when(F.col("l_returnflag") == "N", "needs_manual_review").otherwise("reject"), F.round(F.col("l_discount") * 100)),
        (F.when(F.col("l_linestatus") == "F", "accept").otherwise("reject"), F.round(F.col("l_tax") * 100)),
    ).drop("l_returnflag", "l_linestatus", "l_discount", "l_tax")
    out = parents.unionByName(children)
    expected = F.when(F.col("key") % 17 != 0, F.col("target"))
    return out.withColumn("expected_decision", expected).withColumn("repeat_index", F.lit(0)).withColumn("correct", is_correct()).withColumn("row_id", F.xxhash64("case_id")).drop("target", "key")


def most_records(spark: SparkSession, sf_dir: str) -> int:
    """How many :func:`records` there are at most."""
    return 2 * sum(read(spark, sf_dir, name).count() for name in ("orders", "lineitem"))


def pair_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders 2k and 2k + 1 as an authored pair; the second member of every ninth pair names another one."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 2).cast("long").alias("pair"))
    other = (F.col("o_orderkey") % 2 == 1) & (F.col("pair") % 9 == 0)
    return o.select(F.concat(F.lit("o"), "o_orderkey").alias("case_id"), F.concat(F.when(other, "q").otherwise("p"), "pair").alias("pair_id"), F.when(F.col("o_orderkey") % 2 == 0, "plain").otherwise("polished").alias("pair_role"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcomes: a user and day is a case, the order of its events the repeat."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select(
        "user_id", "event_type", "event_id", (F.row_number().over(w) - 1).alias("repeat_index"), F.coalesce(F.round(F.col("value") * 100).cast("long"), F.lit(0)).alias("units"),
    )
    return e.select(
        F.concat(F.lit("c"), F.col("user_id") % 3).alias("condition"), F.concat("event_type", F.lit("-"), "user_id").alias("case_id"), "repeat_index", "event_id",
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "not_run").otherwise("success").alias("status"),
        F.when(F.col("event_id") % 3 == 0, "accept").when(F.col("event_id") % 3 == 1, "reject").otherwise("needs_manual_review").alias("decision"),
        F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 4 == 0, "timeout").when(F.col("event_id") % 4 == 1, "schema").otherwise("transport")).alias("error_kind"),
        F.pmod("units", F.lit(10001)).alias("units"),
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as votes of three models on a pair: a model's vote is the least over its lines."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", ((F.col("l_linenumber") - 1) % 3 + 1).alias("l_linenumber")).agg(F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"), F.min("l_partkey").alias("p"))
    answer = F.when(F.col("f") == "A", "yes").when(F.col("f") == "N", "no").otherwise("uncertain")
    return rows.select(
        F.concat(F.lit("o"), "l_orderkey").alias("pair_id"), F.concat(F.lit("m"), "l_linenumber").alias("model"), answer.alias("quality_changed"),
        F.when(F.col("p") % 3 == 0, "yes").when(F.col("p") % 3 == 1, "no").otherwise("uncertain").alias("action_changed"),
    )
