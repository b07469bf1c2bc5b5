"""Discovery of fixtures below a root: what is generated is left out, and reports must lie inside the root.

A listing is a table of files (path, content), as Spark reads it from any file system, or made in any other way.  A folder that holds an index of
a generated suite is left out with everything below it: every manifest's folder and the folders above it meet those that hold an index in
one join.  A manifest names its report relative to the root; the path is put together without the file system, so links are not followed.

Defined results: a folder with both manifests is canonical; an empty listing has no fixtures; empty and ``.`` parts of a path say nothing; a report that
is not there, lies outside or has no first-level heading is a problem of its manifest, and of several the first one is named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.text import has_heading
from assay.operators.integrity import require_none
from assay.sources.reports import MANIFEST, _parse
from assay.storage import dealt

# Names of the files of a corpus.
CANONICAL, DERIVED, INDEX = "manifest.yaml", "mutation-manifest.yaml", "suite-index.jsonl"
#: Manifests that one task reads.
PARSED = 5_000


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of manifests, Markdown files and indexes below ``root``; contents are read where they are asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{{{CANONICAL},{DERIVED},{INDEX},*.md}}").load(root)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("content").alias("content"))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def with_above(of_folder: Column) -> Column:
    """A folder and all folders above it."""
    parts = F.split(of_folder, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def hidden(files: DataFrame, index: str = INDEX) -> DataFrame:
    """(folder) of the files that are in or below a folder that holds an index."""
    generated = files.where(name(F.col("path")) == index).select(folder(F.col("path")).alias("above")).distinct()
    places = files.select(folder(F.col("path")).alias("folder")).distinct()
    return places.withColumn("above", F.explode(with_above(F.col("folder")))).join(generated, "above", "left_semi").select("folder").distinct()


def pruned(files: DataFrame, index: str = INDEX) -> DataFrame:
    """The files that are not in or below a folder that holds an index."""
    return files.withColumn("folder", folder(F.col("path"))).join(hidden(files, index), "folder", "left_anti")


def resolved(root: str, relative: Column) -> Column:
    """The path that a manifest means by ``relative``; NULL if it lies outside the root."""
    whole = F.when(F.startswith(relative, F.lit("/")), relative).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), relative))
    none = F.array().cast("array<string>")
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
    parts = F.aggregate(F.split(whole, "/"), none, lambda acc, p: F.when(p == "..", up(acc)).when(p.isin("", "."), acc).otherwise(F.concat(acc, F.array(p))))
    path = F.concat(F.lit("/"), F.array_join(parts, "/"))
    return F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), path)


def fixtures(files: DataFrame, root: str) -> DataFrame:
    """Every manifest that is not generated: kind, folder, the fields of a manifest, ``path`` and ``raw_text`` of its report, and ``problem``, NULL if it has none."""
    # folders are looked up for manifests and for what they name, so texts move once, to their manifest
    generated = hidden(files)
    found = files.where(name(F.col("path")).isin(CANONICAL, DERIVED)).select(folder(F.col("path")).alias("folder"), F.col("content").cast("string").alias("content"), name(F.col("path")).alias("file"))
    # a manifest is few bytes and much work, so their number and not their size says how many tasks they need
    found = dealt(found, found.count(), "folder", per_task=PARSED).join(generated, "folder", "left_anti")
    # of two manifests in one folder the canonical one counts
    found = found.groupBy("folder").agg(F.min(F.struct((F.col("file") != CANONICAL).alias("other"), "content")).alias("m")).select("folder", "m.content", F.when(F.col("m.other"), "derived").otherwise("canonical").alias("kind"))
    told = found.mapInPandas(_parse, f"folder string, {MANIFEST}, kind string").withColumn("path", resolved(root, F.coalesce("report_path", F.lit(""))))
    fields = [c for c in told.columns if c not in ("folder", "path")]
    told = told.withColumn("_of", folder(F.col("path"))).join(generated.select(F.col("folder").alias("_of"), F.lit(True).alias("_hidden")), "_of", "left")
    texts = files.where(F.endswith(F.col("path"), F.lit(".md"))).select(F.col("path").alias("_path"), F.col("content").cast("string").alias("raw_text"))
    both = told.join(texts, (F.col("path") == F.col("_path")) & F.col("_hidden").isNull(), "left").select("folder", "path", *fields, "raw_text")
    both = both.withColumn("headed", F.coalesce(has_heading(F.col("raw_text"), 1), F.lit(False)))
    problem = F.when(F.col("path").isNull(), "the report lies outside the root").when(F.col("raw_text").isNull(), "there is no such report").when(~F.col("headed"), "the report has no first-level heading")
    return both.withColumn("problem", problem).drop("headed")


def discover(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(canonical, derived) fixtures below ``root``, in order of their ids; a fixture with a problem is an error."""
    found = fixtures(listing(spark, root), root)
    require_none(found.where("problem is not null").select("folder", "problem"), "a fixture cannot be read")
    return tuple(found.where(F.col("kind") == kind).orderBy("id") for kind in ("canonical", "derived"))
