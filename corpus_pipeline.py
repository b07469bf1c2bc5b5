"""A training-corpus pipeline: five stages, each over all that its predecessor kept.

Stages 1 and 2 drop documents, stages 1, 3 and 4 cut lines or spans out of texts (and bring
``n_chars`` up to date), stage 5 encodes and decodes.

A row is known by its id and the hash of its text, so rows that share an id, or have none, are judged and cut on their own.
Defined results: null and blank texts fail the quality rules; repeated rows (same id and text) are one document and stay or go
together; ties between equal documents go to the smallest id; texts of any length count whole; an empty table gives an empty
result; extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import decontaminate, near_dup, pieces, quality_rules, unit_dedup
from assay.llm.catalog import PIECE_MODEL
from assay.llm.common import table, written


def _without(docs: DataFrame, rejected: DataFrame, **more: str) -> DataFrame:
    """``docs`` less the rows in ``rejected`` (doc_id, content, and columns of ``more``: name in ``rejected`` to an expression over ``docs``)."""
    key = {"doc_id": "doc_id", "content": "xxhash64(text)", **more}
    gone = rejected.select(*(F.col(c).alias(f"__{c}") for c in key)).distinct()
    same = None
    for c, own in key.items():
        one = F.expr(own).eqNullSafe(F.col(f"__{c}"))
        same = one if same is None else same & one
    return docs.join(gone, same, "left_anti")


def _cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    return _counted(unit_dedup.without_spans(docs, spans))


def _counted(out: DataFrame) -> DataFrame:
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    counts = written(quality_rules.text_counts(docs), "counts")
    frequent = written(quality_rules.frequent_lines(counts), "frequent")
    rejected = quality_rules.judged(counts, frequent).where("not kept")
    kept = _without(docs, rejected, content="xxhash64(coalesce(text, ''))", host="coalesce(cast(source as string), '')")
    return _counted(quality_rules.cleaned_texts(kept, counts, frequent).drop("removed"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, near_dup.near_duplicates(docs, width=5, percent=80).where("not kept"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _cut(docs, unit_dedup.repeated_spans(docs))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _cut(docs, decontaminate.contaminated_spans(docs, table(spark, sf_dir, "benchmark")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pieces.encode_documents(docs, PIECE_MODEL)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "begins", "ends", "decoded")


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("substring dedup", substrings),
    ("decontamination", benchmarks),
    ("encoding", encoding),
]

#: SQL has no SentencePiece encoding and no alignment; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
