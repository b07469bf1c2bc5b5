"""Queries of this subpackage over the test tables, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assay.llm import (
    collocations, decontaminate, license_scan, lm_score, near_dup, pieces, quality_model, quality_rules, spelling, sql, token_count, token_store, toxicity, unit_dedup,
)
from assay.llm.common import table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).drop("content")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_digests(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=2)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op7_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("content")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("content")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licensed_documents(table(spark, sf_dir, "documents"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.graded(table(spark, sf_dir, "documents"), quality_model.ratings(table(spark, sf_dir, "labels")))


def op11_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_rules, op2_toxicity, op3_near_dup, op4_token_store, op5_lm_score,
        op6_pieces, op7_unit_dedup, op8_decontaminate, op9_license_scan, op10_quality_model, op11_token_count, op12_spelling, op13_collocations,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The other operators are beyond SQL: a trained model, a tokenizer, an alignment or a compressor decides; tests compare them with brute force."""
    return {"op1_quality_rules": sql.OP1, "op3_near_dup": sql.OP3, "op7_unit_dedup": sql.OP7, "op12_spelling": sql.OP12, "op13_collocations": sql.OP13}
