"""Bootstrap intervals.

The bootstrap of clusters makes its draws in tasks: a cluster takes part in a resample a binomial number of times,
and the clusters of a block share a fixed number of draws that was split over the blocks, so every resample has exactly as many
draws as there are clusters and no list of draws passes through the driver.  Draws are seeded by (seed, block), and blocks are
runs of the clusters in hash order, so results repeat for a seed and do not depend on the layout of the input.
:func:`draws` gives the draws of CPython's generator, for comparison on small inputs.
"""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.schema import is_correct
from assay.storage import stored


def percentile_indices(size: int, ci: float) -> tuple[int, int]:
    """Places of the interval's ends in a sorted list of ``size`` values."""
    if size < 1 or not 0 < ci < 1:
        raise ValueError("needs at least one resample and 0 < ci < 1")
    tail = (1 - ci) / 2
    return min(int(tail * size), size - 1), min(int((1 - tail) * size), size - 1)


def cluster_tallies(records: DataFrame, pair_ids: DataFrame | None = None) -> DataFrame:
    """(evaluator_name, cluster, correct, cases, first_row): a derived case belongs to its parent, a paired report to its pair."""
    base = F.when(F.col("case_kind") == "canonical", F.col("case_id")).otherwise(F.coalesce("parent_id", "case_id"))
    rows = records.select("evaluator_name", base.alias("report"), is_correct().alias("ok"), "row_id")
    if pair_ids is not None:
        rows = rows.join(pair_ids.select(F.col("case_id").alias("report"), "pair_id"), "report", "left").withColumn("report", F.coalesce("pair_id", "report"))
    return rows.groupBy("evaluator_name", F.col("report").alias("cluster")).agg(
        F.count_if("ok").alias("correct"), F.count("*").alias("cases"), F.min("row_id").alias("first_row"),
    )


def draws(spark, clusters: int, resamples: int, seed: int) -> DataFrame:
    """(resample, ordinal, times) of drawing ``clusters`` out of as many, ``resamples`` times."""
    rng, rows, places = random.Random(seed), [], range(clusters)
    for r in range(resamples):
        rows += [(r, k, m) for k, m in Counter(rng.choice(places) for _ in places).items()]
    return spark.createDataFrame(rows, "resample int, ordinal int, times int")


#: Clusters whose draws are made together, and how many blocks there are at most: of many clusters blocks get larger, not more.
BLOCK, BLOCKS = 2_000, 4_096


def _names(tallies: DataFrame) -> list[str]:
    return sorted(r[0] for r in tallies.select("evaluator_name").distinct().collect())


def _sums(tallies: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(evaluator_name, resample, correct, cases) over resamples of the clusters of ``tallies``, which are read twice."""
    names = _names(tallies)
    # two numbers for each evaluator, of which there are few; written once, as clusters are counted before they are drawn
    told = [F.sum(F.when(F.col("evaluator_name") == name, F.col(c)).otherwise(0)).alias(f"{c}_{i}") for i, name in enumerate(names) for c in ("correct", "cases")]
    if not names:
        raise ValueError("no clusters to draw from")
    per_cluster = stored(tallies.groupBy("cluster").agg(*told), "clusters")
    columns = per_cluster.columns[1:]
    n = per_cluster.count()
    blocks = min(-(-n // BLOCK), BLOCKS)
    placed = per_cluster.withColumn("block", F.pmod(F.xxhash64("cluster"), F.lit(blocks)).cast("int"))
    sizes = {r["block"]: r["count"] for r in placed.groupBy("block").count().collect()}  # a number for each block
    order = sorted(sizes)
    # of each resample, how many draws fall into each block
    shares = np.random.default_rng([seed, n]).multinomial(n, np.array([sizes[k] for k in order], float) / n, resamples)
    split = tallies.sparkSession.sparkContext.broadcast({k: shares[:, j].astype(np.int32) for j, k in enumerate(order)})

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        pdf = pdf.sort_values("cluster")
        values = pdf[columns].to_numpy(np.int64)  # whole numbers: exact, and a product in this thread only
        rng, out = np.random.default_rng([seed, 1, block]), np.empty((resamples, values.shape[1]), np.int64)
        for r, m in enumerate(split.value[block]):
            out[r] = np.bincount(rng.integers(0, len(pdf), m), minlength=len(pdf)) @ values
        parts = [pd.DataFrame({"evaluator_name": name, "resample": np.arange(resamples), "correct": out[:, 2 * j], "cases": out[:, 2 * j + 1]}) for j, name in enumerate(names)]
        return pd.concat(parts).astype({"correct": "int64", "cases": "int64"})

    made = placed.groupBy("block").applyInPandas(draw, "evaluator_name string, resample int, correct long, cases long")
    return made.groupBy("evaluator_name", "resample").agg(F.sum("correct").alias("correct"), F.sum("cases").alias("cases"))


def cluster_bootstrap(records: DataFrame, resamples: int = 2000, ci: float = 0.95, seed: int = 0, pair_ids: DataFrame | None = None) -> DataFrame:
    """(name, lo, hi, mean, observed): accuracy of every evaluator, and the difference of the first two by name on the same draws."""
    low, high = percentile_indices(resamples, ci)
    tallies = stored(cluster_tallies(records, pair_ids), "tallies")
    acc = _sums(tallies, resamples, seed).select("evaluator_name", "resample", (F.col("correct") / F.nullif("cases", F.lit(0))).alias("value"))
    # one row for each evaluator and resample, however many records there are
    names = _names(tallies)
    observed = tallies.groupBy("evaluator_name").agg((F.sum("correct") / F.sum("cases")).alias("observed"))
    out = acc.select(F.col("evaluator_name").alias("name"), "resample", "value")
    seen = observed.select(F.col("evaluator_name").alias("name"), "observed")
    if len(names) > 1:
        a, b = names[:2]

        def side(rows: DataFrame, name: str, value: str):
            return F.coalesce(F.max(F.when(F.col("evaluator_name") == name, F.col(value))), F.lit(0.0))

        gap = F.lit(f"{b} minus {a}").alias("name")
        out = out.unionByName(acc.groupBy("resample").agg((side(acc, b, "value") - side(acc, a, "value")).alias("value")).select(gap, "resample", "value"))
        seen = seen.unionByName(observed.agg((side(observed, b, "observed") - side(observed, a, "observed")).alias("observed")).select(gap, "observed"))
    ranked = out.groupBy("name").agg(F.sort_array(F.collect_list("value")).alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda x, y: x + y) / F.size("v")
    return ranked.select("name", F.get("v", F.lit(low)).alias("lo"), F.get("v", F.lit(high)).alias("hi"), mean.alias("mean")).join(seen, "name")


def flip_interval(flips: DataFrame, resamples: int = 2000, ci: float = 0.95, seed: int = 0) -> DataFrame:
    """(lo, hi) of the share of flips in ``flips`` (group, flip: 0 or 1), groups drawn whole; no values below two groups.

    The ends of this interval stand at int(tail * (resamples - 1)).
    """
    tallies = flips.groupBy("group").agg(F.sum("flip").cast("long").alias("correct"), F.count("*").alias("cases"))
    groups = tallies.count()
    if groups < 2:
        return flips.sparkSession.createDataFrame([(None, None)], "lo double, hi double")
    sums = _sums(tallies.select(F.lit("flips").alias("evaluator_name"), F.col("group").alias("cluster"), "correct", "cases"), resamples, seed)
    ordered = sums.agg(F.sort_array(F.collect_list(F.col("correct") / F.col("cases"))).alias("v"))
    tail = (1 - ci) / 2
    return ordered.select(F.get("v", F.lit(int(tail * (resamples - 1)))).alias("lo"), F.get("v", F.lit(int((1 - tail) * (resamples - 1)))).alias("hi"))


def pair_merge(records: DataFrame, pair_ids: DataFrame) -> DataFrame:
    """(pair_merge, mapped): ``applied`` if any report belongs to a pair, else ``skipped``."""
    base = records.select(F.coalesce("parent_id", "case_id").alias("case_id")).distinct()
    mapped = base.join(pair_ids.select("case_id").distinct(), "case_id", "left_semi").agg(F.count("*").alias("mapped"))
    return mapped.select(F.when(F.col("mapped") > 0, "applied").otherwise("skipped").alias("pair_merge"), "mapped")


def row_bootstrap(records: DataFrame, resamples: int = 2000, ci: float = 0.95, seed: int = 0) -> DataFrame:
    """(evaluator_name, lo, point, hi): every resample is a binomial draw of correct rows, which is what drawing rows amounts to.

    Resamples are generated in Spark from the two counts of an evaluator, so the number of rows does not matter.
    """
    low, high = percentile_indices(resamples, ci)
    counts = records.where("expected_decision is not null").groupBy("evaluator_name").agg(F.count("*").alias("n"), F.count_if(is_correct()).alias("correct")).collect()
    rows = []
    for r in sorted(counts):
        values = np.sort(np.random.default_rng(seed).binomial(r["n"], r["correct"] / r["n"], resamples)) / r["n"]
        rows.append((r["evaluator_name"], float(values[low]), r["correct"] / r["n"], float(values[high])))
    return records.sparkSession.createDataFrame(rows, "evaluator_name string, lo double, point double, hi double")
