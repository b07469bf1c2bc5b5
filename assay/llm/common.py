"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six characters.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session does not name one (tests on one machine) is a
    temporary folder made and registered.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(where)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: the
    lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def spent(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` whose last reader has been written itself."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spaced(text: Column, keep: str = "") -> Column:
    """``text`` with every white-space character but ``keep`` turned into a blank."""
    for c in SPACES[1:]:
        if c not in keep:
            text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def blank_words(text: Column) -> Column:
    """The words of a text whose only white space is blanks."""
    return F.array_remove(F.split(text, " "), "")


def sized(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """``df``, the result of a shuffle of about so many rows, in no more tasks than they need.

    Small steps of a loop then do not pay for hundreds of empty tasks; large ones keep all partitions of the shuffle.
    """
    return df.coalesce(max(2, -(-rows // per_task)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the undirected graph ``edges(a, b)``.

    Alternates the large-star and small-star steps until the edge set is a
    star around the smallest node of each component, writing every round to
    the shared folder.  Returns ``(node, component)`` for nodes with an edge.
    Each step is a grouped minimum (combined on the map side) and an equi-join,
    so a hub never gathers its neighbours in one task.  Raises if ``rounds`` do not do (each halves
    long paths; 60 are enough for any graph that fits a cluster).
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    mark = _mark(now)
    for _ in range(rounds if mark[0] else 1):
        if mark[0] == 0:
            break
        size = 2 * mark[0]
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sized(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), size)
        large = sized(both.join(low, "a"), size).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = written(sized(large.distinct(), size), "cc")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = sized(down.groupBy("a").agg(F.min("b").alias("m")), size)
        small = (
            sized(down.join(least, "a"), size).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct()
        )
        before, was, now = mark, now, written(sized(small, size), "cc")
        mark = _mark(now)
        spent(was, large)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components are not stable after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free checksum of an edge set."""
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])
