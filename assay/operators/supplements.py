"""Supplements of a ledger: later rounds of attempts for slots that are still open, each bound to the whole history before it.

A ledger has attempts of slots (slot, attempt, status); round 0 is the base, rounds 1, 2, ... are supplements.  A round is planned before it runs: its
slots with the number and the digest of the attempts that they had (slot, round, previous_attempts, prior_digest), and the digest of
all rows before it (round, prior_digest, max_requests).  Nothing in the past is ever replaced, so a round fits if the past has the digests that it was planned on.

All of it is one scan in order of each slot's rounds and attempts: running counts, running successes, and a running digest, the sum of the rows'
hashes in four parts modulo 2 ** 64.  Slots are short, and a slot that is not takes more of one task's time but no more memory.

Defined results: rows that break several rules are listed for each; repeated rows are a wrong order of attempts; null attempts and statuses are wrong; an empty plan allows
no supplement; an empty table has no problems; extra columns are part of what a row is, but for ``round``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.operators.analysis import digest_halves, joined_halves, row_digest
from assay.operators.integrity import require_none

#: Attempts that a round may add to a slot, and what may come of one.
CAP, STATUSES = 3, ("success", "http_error", "invalid_or_transport_error")
_HALVES = 8


def _hashed(ledger: DataFrame) -> DataFrame:
    """The ledger with the halves of the four parts of each row's hash, which covers all its columns but the round."""
    digest = row_digest(ledger.drop("round"))
    rows = ledger.withColumn("_h", digest)
    return rows.withColumns(digest_halves(F.col("_h"))).drop("_h")


def _digest(n: Column, parts: list[Column]) -> Column:
    return F.sha2(F.concat_ws(":", n.cast("string"), *joined_halves(parts)), 256)


def slot_digests(ledger: DataFrame) -> DataFrame:
    """(slot, attempts, digest) of what every slot of a ledger has so far: what a plan of the next round states."""
    parts = [F.sum(f"_p{k}") for k in range(_HALVES)]
    return _hashed(ledger).groupBy("slot").agg(F.count("*").alias("attempts"), _digest(F.count("*"), parts).alias("digest"))


def round_digests(ledger: DataFrame, rounds: DataFrame | None = None) -> DataFrame:
    """(round, rows, digest) of all rows before each round of the ledger, and of ``rounds`` (round), which may be still empty."""
    sums = _hashed(ledger).groupBy("round").agg(F.count("*").alias("n"), *(F.sum(f"_p{k}").alias(f"_p{k}") for k in range(_HALVES)))
    every = ledger.select("round").union(rounds.select("round")).distinct().join(sums, "round", "left") if rounds is not None else sums
    # a row for each round
    before = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.sum("n").over(before), F.lit(0))
    return every.select("round", n.alias("rows"), _digest(n, [F.sum(f"_p{k}").over(before) for k in range(_HALVES)]).alias("digest"))


def slot_problems(ledger: DataFrame, plan: DataFrame, cap: int = CAP) -> DataFrame:
    """(slot, round, problem) of attempts and plans: ``after_success``, ``attempt``, ``over_cap``, ``status``, ``unplanned``, ``repeated_plan``, ``unknown_slot``, ``changed_history``."""
    # a planned slot is a row of its round before its attempts, so one scan sees plans and attempts in their order
    rows = _hashed(ledger).withColumns({"_kind": F.lit(1), "_planned": F.lit(None).cast("long"), "_prior": F.lit(None).cast("string")})
    keys = ["slot", "round", "attempt", "status", "_kind", "_planned", "_prior", *(f"_p{k}" for k in range(_HALVES))]
    marks = plan.select(
        "slot", "round", F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("string").alias("status"), F.lit(0).alias("_kind"), F.col("previous_attempts").cast("long").alias("_planned"), F.col("prior_digest").alias("_prior"),
        *(F.lit(None).cast("long").alias(f"_p{k}") for k in range(_HALVES)),
    )
    both = rows.select(*keys).unionByName(marks)
    order = Window.partitionBy("slot").orderBy("round", "_kind", F.asc_nulls_first("attempt"), "_p0", "_p1", "_p2", "_p3")
    past, of_round = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("slot", "round").orderBy("_kind", F.asc_nulls_first("attempt"), "_p0", "_p1", "_p2", "_p3").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({
        "_n": F.coalesce(F.sum("_kind").over(past), F.lit(0)), "_won": F.coalesce(F.max(F.col("status") == "success").over(past), F.lit(False)), "_own": F.sum("_kind").over(of_round), "_plans": F.sum(1 - F.col("_kind")).over(of_round),
        "_digest": F.when(F.col("_kind") == 0, _digest(F.coalesce(F.sum("_kind").over(past), F.lit(0)), [F.sum(f"_p{k}").over(past) for k in range(_HALVES)])),
    })
    row, planned = F.col("_kind") == 1, F.col("_kind") == 0
    found = F.array_compact(F.array(
        F.when(row & F.col("_won"), "after_success"), F.when(row & ~F.col("attempt").eqNullSafe((F.col("_n") + 1).cast("int")), "attempt"), F.when(row & (F.col("round") > 0) & (F.col("_own") > cap), "over_cap"),
        F.when(row & ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status"), F.when(row & (F.col("round") > 0) & (F.col("_plans") == 0), "unplanned"), F.when(planned & (F.col("_plans") > 1), "repeated_plan"),
        F.when(planned & (F.col("_n") == 0), "unknown_slot"), F.when(planned & (F.col("_n") > 0) & (F.col("_won") | ~F.col("_planned").eqNullSafe(F.col("_n")) | ~F.col("_prior").eqNullSafe(F.col("_digest"))), "changed_history"),
    ))
    return seen.select("slot", "round", F.explode(found).alias("problem"))


def round_problems(ledger: DataFrame, plan: DataFrame, protocols: DataFrame, cap: int = CAP) -> DataFrame:
    """(round, problem) of protocols (round, prior_digest, max_requests): ``prior_rows``, ``request_cap``, ``too_many_requests``, ``no_protocol``."""
    slots = plan.groupBy("round").agg(F.countDistinct("slot").alias("slots"))
    rows = ledger.groupBy("round").agg(F.count("*").alias("requests")).where("round > 0")
    past = round_digests(ledger, protocols).select("round", "digest")
    every = protocols.withColumn("told", F.lit(True)).join(rows, "round", "full_outer").join(slots, "round", "left").join(past, "round", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    told = F.col("told").isNotNull()
    found = F.array_compact(F.array(
        F.when(~told, "no_protocol"), F.when(told & ~F.col("prior_digest").eqNullSafe(F.col("digest")), "prior_rows"), F.when(told & ~F.col("max_requests").eqNullSafe(cap * zero("slots")), "request_cap"),
        F.when(told & (zero("requests") > zero("max_requests")), "too_many_requests"),
    ))
    return every.select("round", F.explode(found).alias("problem"))


def merged(ledger: DataFrame, plan: DataFrame, protocols: DataFrame, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(ledger, limits): the whole ledger, if every round fits the one before, and for each supplemented slot the last attempt that it may have."""
    require_none(round_problems(ledger, plan, protocols, cap), "a round does not fit the history before it")
    require_none(slot_problems(ledger, plan, cap), "a slot does not fit its plan")
    limits = plan.groupBy("slot").agg(F.max(F.col("previous_attempts") + cap).alias("limit"))
    return ledger, limits
