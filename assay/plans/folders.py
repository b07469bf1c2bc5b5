"""A listing of files made of documents: folders by source and language, some of which hold an index; and which fixtures it has, in SQL.

Texts decide: a report is the document's own text, sizes and languages make the paths that leave the root, name nothing or lack a heading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.plans.bindings import read

ROOT = "/corpus"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")
    place = F.concat(F.lit(f"{ROOT}/"), "source", F.lit("/"), "lang", F.lit("/case-"), F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "lang", "source", "text", place.alias("place"), size.alias("size"))
    relative = F.when(F.col("size") > 8000, F.concat(F.lit("../"), "source", F.lit("/report.md"))).otherwise(F.concat("source", F.lit("/./x/../"), "lang", F.lit("/case-"), F.col("doc_id").cast("string"), F.when(F.col("size") < 300, "/none.md").otherwise("/report.md")))
    file = F.when(F.col("lang") == "fr", "mutation-manifest.yaml").otherwise("manifest.yaml")
    manifests = rows.select(F.concat("place", F.lit("/"), file).alias("path"), F.concat(F.lit("id: f"), F.col("doc_id").cast("string"), F.lit("\nreport:\n  path: "), relative, F.lit("\n")).alias("content"))
    head = F.when(F.col("size") % 5 == 0, "## Second\n").otherwise("# First\n")
    reports = rows.select(F.concat("place", F.lit("/report.md")).alias("path"), F.concat(head, F.replace("text", F.lit("#"), F.lit(" "))).alias("content"))
    # a source's folder of a language is generated if its largest text is small; and a whole source if the largest of all its texts is
    large = rows.groupBy("source", "lang").agg(F.max("size").alias("m")).where("m < 6500").select(F.concat(F.lit(f"{ROOT}/"), "source", F.lit("/"), "lang").alias("place"))
    whole = rows.groupBy("source").agg(F.max("size").alias("m")).where("m < 9100").select(F.concat(F.lit(f"{ROOT}/"), "source").alias("place"))
    indexes = large.union(whole).select(F.concat("place", F.lit("/suite-index.jsonl")).alias("path"), F.lit("{}").alias("content"))
    return manifests.unionByName(reports).unionByName(indexes)


SQL = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, length(coalesce(text, '')) AS size FROM documents),
m AS (SELECT *, max(size) OVER (PARTITION BY source, lang) AS of_lang, max(size) OVER (PARTITION BY source) AS of_source FROM d)
SELECT '{ROOT}/' || source || '/' || lang || '/case-' || doc_id AS folder, CASE WHEN lang = 'fr' THEN 'derived' ELSE 'canonical' END AS kind, 'f' || doc_id AS id,
CASE WHEN size > 8000 THEN 'the report lies outside the root' WHEN size < 300 THEN 'there is no such report' WHEN size % 5 = 0 THEN 'the report has no first-level heading' END AS problem,
CASE WHEN size BETWEEN 300 AND 8000 THEN size + CASE WHEN size % 5 = 0 THEN 10 ELSE 8 END END AS chars
FROM m WHERE of_lang >= 6500 AND of_source >= 9100
"""
