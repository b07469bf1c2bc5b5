"""Markdown reports with YAML manifests, as Spark reads them from any file system."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = (
    "id string, title string, source_type string, license string, report_class string, pair_id string, pair_role string, parent_id string, operator string, category string, "
    "seed decimal(20,0), variant_index int, expected_decision string, expected_dimensions map<string,double>, required_evidence array<string>, reproducible boolean, impact_class string, "
    "report_path string, parameters string, sanitization_note string"
)


def _files(spark: SparkSession, root: str, name: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    return raw.select(F.regexp_replace("path", r"/[^/]+$", "").alias("folder"), F.decode("content", "UTF-8").alias("content"))


def _parse(batches):
    """Manifests (folder, content, ...) read; other columns come last, as they are."""
    import yaml

    for pdf in batches:
        rows, others = [], [c for c in pdf.columns if c not in ("folder", "content")]
        for folder, content, *more in zip(pdf["folder"], pdf["content"], *(pdf[c] for c in others)):
            m = yaml.safe_load(content)
            if not isinstance(m, dict):
                raise ValueError(f"{folder}: a manifest must be a mapping")
            truth = m.get("ground_truth") or {}
            dims = m.get("expected_dimensions") or truth.get("expected_dimensions") or {}
            rows.append({
                "folder": folder, **{k: m.get(k) for k in ("id", "title", "source_type", "license", "report_class", "pair_id", "pair_role", "parent_id", "operator", "category", "variant_index", "expected_decision", "sanitization_note")},
                "seed": None if m.get("seed") is None else __import__("decimal").Decimal(m["seed"]), "expected_dimensions": {k: float(v) for k, v in dims.items()},
                "required_evidence": list(truth.get("required_evidence") or []), "reproducible": truth.get("reproducible"), "impact_class": truth.get("impact_class"),
                "report_path": (m.get("report") or {}).get("path"), "parameters": json.dumps(m.get("parameters") or {}, sort_keys=True),
                **dict(zip(others, more)),
            })
        names = ["folder"] + [c.strip().rsplit(" ", 1)[0].split(" ")[0] for c in _columns()] + others
        yield pd.DataFrame(rows, columns=names)


def _columns() -> list[str]:
    out, depth, part = [], 0, ""
    for ch in MANIFEST:
        depth += (ch in "(<") - (ch in ")>")
        if ch == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


def manifests(spark: SparkSession, root: str, name: str = "manifest.yaml") -> DataFrame:
    """A row per manifest file below ``root``: folder and the fields of :data:`MANIFEST`."""
    return _files(spark, root, name).mapInPandas(_parse, f"folder string, {MANIFEST}")


def reports(spark: SparkSession, root: str, manifest_name: str = "manifest.yaml", report_name: str = "report.md") -> DataFrame:
    """Manifests joined with the report beside them; (report_id, raw_text, ...)."""
    texts = _files(spark, root, report_name).withColumnRenamed("content", "raw_text")
    return manifests(spark, root, manifest_name).join(texts, "folder").withColumnRenamed("id", "report_id")


def fixture_problems(found: DataFrame) -> DataFrame:
    """(folder, problem) of structured reports: id other than its folder, title other than its first heading, no level-1 heading."""
    folder = F.regexp_extract("folder", r"([^/]+)$", 1)
    bad_id = F.when(~F.endswith(F.col("report_id"), folder), "id does not match its folder")
    bad_title = F.when(F.col("manifest_title") != F.col("title"), "title does not match the first heading")
    no_h1 = F.when(~F.exists("sections", lambda s: s.level == 1), "no level-1 heading")
    return found.select("folder", F.explode(F.array_compact(F.array(bad_id, bad_title, no_h1))).alias("problem"))
