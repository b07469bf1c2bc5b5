"""Agreement metrics: one grouped aggregate over the records, one equi-join for paired metrics.

Every function takes records and grouping columns (``by``, the evaluator by default) and
returns a row per group.  Ratios without an eligible row are NULL, except plain
accuracy, which is 0.  Counts come with every ratio.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.schema import ACCEPT, DIMENSIONS, REJECT, class_default, is_changing, is_correct, is_presentation, is_preserving

BY = ("evaluator_name",)


def n(condition: Column) -> Column:
    """How many rows meet a condition."""
    return F.count_if(condition).cast("long")


def ratio(part: Column | str, whole: Column | str) -> Column:
    """One division of counts; NULL where the whole is 0."""
    part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def scored() -> Column:
    return F.col("expected_decision").isNotNull()


def decision_accuracy(records: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    out = records.groupBy(*by).agg(n(scored()).alias("total_cases"), n(is_correct()).alias("correct_cases"), n(~scored()).alias("unscored_cases"))
    return out.withColumn("decision_accuracy", F.coalesce(ratio("correct_cases", "total_cases"), F.lit(0.0)))


def false_reassurance(records: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Accepted among the scored rows that should not be accepted."""
    due = scored() & (F.col("expected_decision") != ACCEPT)
    out = records.groupBy(*by).agg(n(due).alias("eligible"), n(due & (F.col("decision") == ACCEPT)).alias("reassured"))
    return out.withColumn("false_reassurance_rate", ratio("reassured", "eligible"))


def over_rejection(records: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    due = F.col("expected_decision") == ACCEPT
    out = records.groupBy(*by).agg(n(due).alias("eligible"), n(due & (F.col("decision") == REJECT)).alias("rejected"))
    return out.withColumn("over_rejection_rate", ratio("rejected", "eligible"))


def changing_target_accuracy(records: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Rows whose mutation changes the target, and how many meet it."""
    out = records.groupBy(*by).agg(n(is_changing()).alias("eligible"), n(is_changing() & is_correct()).alias("matched"))
    return out.withColumn("target_accuracy", ratio("matched", "eligible"))


def with_parents(children: DataFrame, records: DataFrame) -> DataFrame:
    """``children`` left joined with the canonical row of their parent, evaluator and repeat.

    A parent may have very many children, so neither side is forced to be broadcast:
    Spark picks by size, and adaptive execution splits skewed partitions.
    """
    parents = records.where("case_kind = 'canonical'").select(
        F.col("case_id").alias("p_id"), F.col("evaluator_name").alias("p_evaluator"), F.col("repeat_index").alias("p_repeat"),
        F.col("decision").alias("parent_decision"), F.col("expected_decision").alias("parent_expected"), F.col("report_class").alias("parent_class"),
    )
    on = (F.col("parent_id") == F.col("p_id")) & (F.col("evaluator_name") == F.col("p_evaluator")) & (F.col("repeat_index") == F.col("p_repeat"))
    return children.join(parents, on, "left").drop("p_evaluator", "p_repeat")


def preserving_drift(records: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """How often a decision moves although the mutation keeps the target."""
    pairs = with_parents(records.where(is_preserving()), records)
    out = pairs.groupBy(*by).agg(
        F.count("*").alias("considered"), F.count("p_id").alias("paired"), n(F.col("p_id").isNull()).alias("missing_parent"),
        n(F.col("decision") != F.col("parent_decision")).alias("moved"),
    )
    return out.withColumn("drift", ratio("moved", "paired"))


def presentation_susceptibility(records: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Mean change of acceptance from parent to child under presentation operators."""
    pairs = with_parents(records.where(is_presentation()), records)
    ok = F.col("p_id").isNotNull() & ~F.col("parent_expected").eqNullSafe(ACCEPT)
    out = pairs.groupBy(*by).agg(
        F.count("*").alias("considered"), n(ok).alias("paired"), n(~ok).alias("unresolved"),
        (n(ok & (F.col("decision") == ACCEPT)) - n(ok & (F.col("parent_decision") == ACCEPT))).alias("accept_change"),
    )
    return out.withColumn("susceptibility", ratio("accept_change", "paired"))


def in_range() -> Column:
    c = F.col("confidence")
    return c.isNotNull() & ~F.isnan(c) & c.between(0.0, 1.0)


def exact(value: Column) -> Column:
    """A double as the decimal that it is written as, so that sums do not depend on the order of rows."""
    return value.cast("decimal(28,18)")


def confidence_bin(bins: int = 10) -> Column:
    """Equal bins with edges b / bins; the last one is closed."""
    c = F.col("confidence")
    bin_ = F.lit(0)
    for b in range(1, bins):
        bin_ = F.when(c >= b / bins, b).otherwise(bin_)
    return bin_


def calibration_bins(records: DataFrame, by: Sequence[str] = BY, bins: int = 10) -> DataFrame:
    """Per bin: rows, mean confidence, accuracy.  Confidences are summed exactly, as decimals."""
    rows = records.where(scored() & in_range()).withColumn("bin", confidence_bin(bins))
    total = F.sum(exact(F.col("confidence"))).cast("double")
    out = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), total.alias("t"), n(is_correct()).alias("correct"))
    return out.select(*by, "bin", "n", "correct", ratio("t", "n").alias("mean_confidence"), ratio("correct", "n").alias("accuracy"))


def calibration_error(records: DataFrame, by: Sequence[str] = BY, bins: int = 10) -> DataFrame:
    """Expected calibration error, in bin order so that the sum does not depend on partitions."""
    b = calibration_bins(records, by, bins)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("bin", "n", "mean_confidence", "accuracy"))), lambda x: x.n * F.abs(x.mean_confidence - x.accuracy))
    out = b.groupBy(*by).agg(F.sum("n").alias("in_range"), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("weighted"))
    seen = records.where(scored()).groupBy(*by).agg(n(~in_range()).alias("out_of_range"))
    return seen.join(out, list(by), "left").select(*by, F.coalesce("in_range", F.lit(0)).alias("in_range"), "out_of_range", (F.col("weighted") / F.col("in_range")).alias("calibration_error"))


def dimension_mae(records: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Mean absolute error of every dimension that has an expectation; errors are summed exactly, as decimals."""
    rows = records.where(scored()).select(*by, F.explode(F.array(*map(F.lit, DIMENSIONS))).alias("dimension"), "dimensions", "expected_dimensions")
    gap = F.abs(exact(F.col("dimensions")[F.col("dimension")]) - exact(F.col("expected_dimensions")[F.col("dimension")]))
    out = rows.select(*by, "dimension", gap.alias("gap")).where("gap is not null")
    out = out.groupBy(*by, "dimension").agg(F.count("*").alias("n"), F.sum("gap").cast("double").alias("total"))
    return out.select(*by, "dimension", "n", ratio("total", "n").alias("mae"))


def per_class_accuracy(records: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Accuracy by report class, and of canonical rows as a class of their own."""
    rows = records.where(scored())
    classes = rows.select(*by, F.col("report_class").alias("class"), "expected_decision", "decision")
    whole = rows.where("case_kind = 'canonical'").select(*by, F.lit("canonical_overall").alias("class"), "expected_decision", "decision")
    out = classes.unionByName(whole).groupBy(*by, "class").agg(F.count("*").alias("total"), n(is_correct()).alias("correct"))
    return out.withColumn("accuracy", ratio("correct", "total"))


def _conditions() -> dict[str, Column]:
    """What rows are counted by, one by one."""
    e, d = F.col("expected_decision"), F.col("decision")
    canonical = F.col("case_kind") == "canonical"
    return {
        "total_cases": scored(), "correct_cases": is_correct(), "unscored_cases": ~scored(), "f_due": scored() & (e != ACCEPT), "reassured": scored() & (e != ACCEPT) & (d == ACCEPT),
        "o_due": e == ACCEPT, "rejected": (e == ACCEPT) & (d == REJECT), "t_due": is_changing(), "matched": is_changing() & is_correct(), "c_due": canonical & scored(), "c_hit": canonical & is_correct(),
    }


def _tallies(bins: int = 10) -> list[Column]:
    """All counts that unpaired metrics need, for one aggregate."""
    out = [n(met).alias(k) for k, met in _conditions().items()]
    confidence = exact(F.col("confidence"))
    for k in range(bins):
        here = scored() & in_range() & (confidence_bin(bins) == k)
        out += [n(here).alias(f"n_{k}"), F.sum(F.when(here, confidence)).cast("double").alias(f"s_{k}"), n(here & is_correct()).alias(f"k_{k}")]
    return out


#: What rows with a parent are counted by besides: pairs that keep the target and those that move, presented pairs and those that their row or their parent accepts.
_PAIRED = ("d_pairs", "d_moved", "s_pairs", "s_accepted", "s_parent_accepted")


def _bits(conditions: dict[str, Column], first: int = 0) -> Column:
    """A whole number with a bit for each condition that holds."""
    return reduce(add, (F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values(), first)))


def _kinds(records: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """Rows of ``records`` counted by what they and their pairs meet and by their bin, with the sum of their confidences: few rows for any table."""
    here, own = scored() & in_range(), _conditions()
    keys = dict.fromkeys((*by, "evaluator_name", "repeat_index", "parent_id", "decision"))
    met = _bits(own | {"kept": is_preserving(), "shown": is_presentation()})  # bits of pairs are put in place of the last two
    rows = records.select(*keys, met.alias("_met"), F.when(here, confidence_bin(bins)).alias("_bin"), F.when(here, F.col("confidence")).alias("_confidence"))
    # rows without a parent stay out of the join, where they would all have one key
    pairs = with_parents(rows.where("parent_id is not null"), records)
    paired, bit = F.col("p_id").isNotNull(), lambda k: F.col("_met").bitwiseAND(1 << k) != 0
    kept, shown = bit(len(own)) & paired, bit(len(own) + 1) & paired & ~F.col("parent_expected").eqNullSafe(ACCEPT)
    told = (kept, kept & (F.col("decision") != F.col("parent_decision")), shown, shown & (F.col("decision") == ACCEPT), shown & (F.col("parent_decision") == ACCEPT))
    alone = F.col("_met").bitwiseAND((1 << len(own)) - 1)
    out = [pairs.withColumn("_met", alone + _bits(dict(zip(_PAIRED, told)), len(own))), rows.where("parent_id is null").withColumn("_met", alone)]
    both = reduce(DataFrame.unionByName, (x.select(*by, "_met", "_bin", exact(F.col("_confidence")).alias("_confidence")) for x in out))
    return both.groupBy(*by, "_met", "_bin").agg(F.count("*").alias("_n"), F.sum("_confidence").alias("_t"))


def _tallies_of_kinds(bins: int = 10) -> list[Column]:
    """:func:`_tallies`, and those of pairs, of the rows of :func:`_kinds`."""
    names = [*_conditions(), *_PAIRED]
    has = lambda name: F.col("_met").bitwiseAND(1 << names.index(name)) != 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0).cast("long"))
    out = [count(has(k)).alias(k) for k in names]
    for k in range(bins):
        here = F.col("_bin") == k
        out += [count(here).alias(f"n_{k}"), F.sum(F.when(here, F.col("_t"))).cast("double").alias(f"s_{k}"), count(here & has("correct_cases")).alias(f"k_{k}")]
    return out


def _rates(bins: int = 10) -> dict[str, Column]:
    """Metrics from :func:`_tallies`; the calibration error adds the bins in order."""
    gaps = [F.coalesce(F.col(f"n_{k}") * F.abs(ratio(f"s_{k}", f"n_{k}") - ratio(f"k_{k}", f"n_{k}")), F.lit(0.0)) for k in range(bins)]
    weighted, seen = F.lit(0.0), F.lit(0)
    for k, gap in enumerate(gaps):
        weighted, seen = weighted + gap, seen + F.col(f"n_{k}")
    return {
        "decision_accuracy": F.coalesce(ratio("correct_cases", "total_cases"), F.lit(0.0)), "false_reassurance_rate": ratio("reassured", "f_due"), "over_rejection_rate": ratio("rejected", "o_due"),
        "target_accuracy": ratio("matched", "t_due"), "canonical_accuracy": ratio("c_hit", "c_due"), "calibration_error": weighted / F.nullif(seen.cast("double"), F.lit(0.0)),
    }


def metric_bundle(records: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """All headline metrics in one row per group, with the auxiliary weighted score over those that are defined.

    One join with the parents and one aggregate serve all of them.
    """
    out = _kinds(records, by).groupBy(*by).agg(*_tallies_of_kinds())
    out = out.withColumns(_rates() | {"drift": ratio("d_moved", "d_pairs"), "susceptibility": ratio(F.col("s_accepted") - F.col("s_parent_accepted"), "s_pairs")})
    names = ("decision_accuracy", "false_reassurance_rate", "over_rejection_rate", "target_accuracy", "drift", "susceptibility", "calibration_error", "canonical_accuracy")
    return out.select(*by, "total_cases", "correct_cases", *names).withColumn("robustness_score", weighted_score())


#: Weights of the auxiliary score.
WEIGHTS = (("target_accuracy", 0.40), ("false_reassurance_rate", 0.25), ("canonical_accuracy", 0.15), ("calibration_error", 0.10), ("susceptibility", 0.10))


def weighted_score() -> Column:
    """Weighted mean of the defined parts; NULL if none is.  Not rounded."""
    value = {
        "target_accuracy": F.col("target_accuracy"), "false_reassurance_rate": 1 - F.col("false_reassurance_rate"), "canonical_accuracy": F.col("canonical_accuracy"),
        "calibration_error": 1 - F.col("calibration_error"), "susceptibility": F.when(F.col("susceptibility").isNotNull(), 1 - F.greatest(F.lit(0.0), F.col("susceptibility"))),
    }
    total = sum((F.coalesce(value[k] * w, F.lit(0.0)) for k, w in WEIGHTS), F.lit(0.0))
    weight = sum((F.when(value[k].isNotNull(), w).otherwise(0.0) for k, w in WEIGHTS), F.lit(0.0))
    return total / F.nullif(weight, F.lit(0.0))


def metric_coverage(records: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """A row per metric: eligible rows, rows left out, and why the metric is undefined, if it is."""
    drift = preserving_drift(records, by).select(*by, F.col("paired").alias("d_ok"), F.col("missing_parent").alias("d_out"))
    shown = presentation_susceptibility(records, by).select(*by, F.col("paired").alias("s_ok"), F.col("unresolved").alias("s_out"))
    e = F.col("expected_decision")
    base = records.groupBy(*by).agg(
        n(scored()).alias("a"), n(~scored()).alias("a_out"), n(scored() & (e != ACCEPT)).alias("f"), n(e == ACCEPT).alias("o"),
        n(is_changing()).alias("t"), n(scored() & in_range()).alias("c"), n(scored() & ~in_range()).alias("c_out"),
    )
    base = base.join(drift, list(by), "left").join(shown, list(by), "left")
    names = [("decision_accuracy", "a", "a_out"), ("false_reassurance", "f", None), ("over_rejection", "o", None), ("target_accuracy", "t", None), ("preserving_drift", "d_ok", "d_out"), ("presentation_susceptibility", "s_ok", "s_out"), ("calibration_error", "c", "c_out")]
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(k), F.lit(0)).cast("long").alias("eligible"), (F.coalesce(F.col(x), F.lit(0)) if x else F.lit(0)).cast("long").alias("excluded")) for m, k, x in names))).alias("m")
    return base.select(*by, rows).select(*by, "m.*").withColumn("undefined_reason", F.when(F.col("eligible") == 0, F.concat(F.lit("no eligible rows for "), "metric")))


def by_operator(records: DataFrame) -> DataFrame:
    """Accuracy metrics per operator.  Parents carry no operator, so paired metrics do not exist in such a subset."""
    out = records.where("operator is not null").groupBy("evaluator_name", "operator").agg(*_tallies()).withColumns(_rates())
    names = ("total_cases", "correct_cases", "unscored_cases", "decision_accuracy", "reassured", "false_reassurance_rate", "matched", "target_accuracy", "calibration_error")
    return out.select("evaluator_name", "operator", *names)


def breakdown(records: DataFrame) -> DataFrame:
    """Accuracy metrics in total, per report class and per operator, with canonical rows apart, from one scan: evaluator_name, level, value, the metrics.

    Each row is grouped once for every level; ``value`` is NULL in total, and rows without an operator have no row of that level.
    """
    rows = records.withColumn("canonical", F.when(F.col("case_kind") == "canonical", "canonical_overall"))
    e, c, o, k = (F.col(x) for x in ("evaluator_name", "report_class", "operator", "canonical"))
    sets = rows.groupingSets([[e], [e, c], [e, o], [e, k]], e, c, o, k).agg(F.grouping_id().alias("g"), *_tallies()).withColumns(_rates())
    # a bit of g for each column that a level does not have, the evaluator's first
    level = F.when(F.col("g") == 0b0111, "total").when(F.col("g") == 0b0011, "report_class").when(F.col("g") == 0b0101, "operator").otherwise("canonical")
    out = sets.withColumn("level", level).withColumn("value", F.coalesce(c, o, k)).where((F.col("level").isin("total", "report_class")) | F.col("value").isNotNull())
    names = ("total_cases", "correct_cases", "unscored_cases", "decision_accuracy", "reassured", "false_reassurance_rate", "rejected", "over_rejection_rate", "matched", "target_accuracy", "calibration_error")
    return out.select("evaluator_name", "level", "value", *names)


def by_class(records: DataFrame) -> DataFrame:
    """Metrics per report class; parents of the same class pair with their children."""
    keys = ["evaluator_name", "report_class"]
    same = with_parents(records.where(is_preserving()), records)
    ok = F.col("parent_class") == F.col("report_class")
    drift = same.groupBy(*keys).agg(n(ok).alias("paired"), n(ok & (F.col("decision") != F.col("parent_decision"))).alias("moved"))
    out = decision_accuracy(records, keys).join(drift, keys, "left")
    return out.withColumn("drift", ratio("moved", "paired"))


def error_taxonomy(records: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Counts of named errors; correct and unscored rows have none."""
    from assay.schema import ERROR_CODES

    code = F.lit("other_misclassification")
    for (expected, decided), name in ERROR_CODES.items():
        code = F.when((F.col("expected_decision") == expected) & (F.col("decision") == decided), name).otherwise(code)
    wrong = records.where(scored() & ~is_correct()).withColumn("error_code", code)
    return wrong.groupBy(*by, "error_code").agg(F.count("*").alias("n"))


def class_default_rows(records: DataFrame) -> DataFrame:
    """Records with the decision their class implies, and whether the target departs from it."""
    return records.withColumn("default_decision", class_default("report_class")).withColumn("departs", is_changing())
