"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; only a local master may do without that setting."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(table: DataFrame, name: str) -> DataFrame:
    """``table`` written once and read back: what was drawn or numbered in it stays as it is, whatever task is run again."""
    path = scratch(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


#: Rows of a table that a task gets where they are dealt out by a key.
PER_TASK = 250_000


def dealt(table: DataFrame, rows: int, *keys: str, per_task: int | None = None) -> DataFrame:
    """``table`` dealt out by ``keys`` into as many partitions as ``rows`` rows need, so that what a task sorts or groups does not grow with the table."""
    return table.repartition(max(table.sparkSession.sparkContext.defaultParallelism, 1 + rows // (per_task or PER_TASK)), *keys)
