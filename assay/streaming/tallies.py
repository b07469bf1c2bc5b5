"""Accuracy of evaluators over event-time windows: an extension, with no counterpart in the batch contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.operators.metrics import decision_accuracy


def windowed_accuracy(records: DataFrame, time_col: str = "decided_at", window: str = "10 minutes", lateness: str = "30 minutes") -> DataFrame:
    """``decision_accuracy`` per evaluator and window of a stream; rows later than ``lateness`` are dropped by the watermark."""
    rows = records.withWatermark(time_col, lateness).withColumn("window", F.window(time_col, window))
    return decision_accuracy(rows, ("window", "evaluator_name")).select(F.col("window.start").alias("window_start"), "evaluator_name", "total_cases", "correct_cases", "decision_accuracy")
