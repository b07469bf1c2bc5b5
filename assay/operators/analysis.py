"""Published analyses: metrics bound to the records and failures that they were made of.

A table is bound by its number of rows and a digest of its rows as a multiset: the SHA-256 of each row, added up in four parts modulo 2 ** 64.  It is one
aggregate, so it does not depend on files, order or partitions; a row more, less, twice or changed gives another digest.

An analysis is written into a folder beside its place and moved there whole; it is refused if planned work is not scored, failed or not run.  Reading it
back recomputes everything from the tables: digests, the account of every evaluator against the index, and the metrics.

Defined results: nulls and absent values differ from all others; maps count as sets of entries; empty tables have a digest, too; columns take part by
name, in any order; an extra column is a change.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators.ledgers import accounting
from assay.operators.metrics import metric_bundle

SCHEMA, VERSION = 1, 1
COVERAGE = ("planned", "scored", "failed", "not_run")
_PARTS, _WRAP, _HALF = 4, 1 << 64, 1 << 32


class AnalysisError(ValueError):
    """An analysis that cannot be published, or does not agree with its tables."""


def _has_map(kind: T.DataType) -> bool:
    inside = [kind.valueType] if isinstance(kind, T.MapType) else [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
    return isinstance(kind, T.MapType) or any(map(_has_map, inside))


def _plain(column: Column, kind: T.DataType) -> Column:
    """A column whose maps are arrays of entries sorted by key; lambdas, which are slow, only where maps are inside of others."""
    if isinstance(kind, T.MapType):
        entries = F.map_entries(column)
        if _has_map(kind.valueType):
            entries = F.transform(entries, lambda e: F.struct(e.key.alias("key"), _plain(e.value, kind.valueType).alias("value")))
        return F.sort_array(entries)
    if not _has_map(kind):
        return column
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*(_plain(column[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _plain(x, kind.elementType))
    return column


def row_digest(table: DataFrame) -> Column:
    """SHA-256 of a row of ``table``, its columns in order of their names."""
    fields = sorted(table.schema.fields, key=lambda f: f.name)
    return F.sha2(F.to_json(F.struct(*(_plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields)), {"ignoreNullFields": "false"}), 256)


def digest_halves(digest: Column, name: str = "_p") -> dict[str, Column]:
    """The four parts of a digest as eight whole numbers below 2 ** 32: sums of longs are far cheaper than those of wide decimals, and overflow, an error, beyond 2 ** 31 rows of a group."""
    parts = [F.conv(F.substring(digest, 1 + 16 * k, 16), 16, -10).cast("long") for k in range(_PARTS)]  # a part is read once, with a sign, and then cut in two
    return {f"{name}{2 * k + j}": half for k, x in enumerate(parts) for j, half in enumerate((F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(_HALF - 1))))}


def joined_halves(sums: list[Column]) -> list[Column]:
    """The four parts modulo 2 ** 64, as strings, from the sums of their eight halves; no sum is 0."""
    wide = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(20,0)")
    whole = [(wide(high) % F.lit(_HALF).cast("decimal(20,0)")) * F.lit(_HALF).cast("decimal(18,0)") + wide(low) for high, low in zip(sums[::2], sums[1::2])]
    return [(x % F.lit(str(_WRAP)).cast("decimal(38,0)")).cast("decimal(38,0)").cast("string") for x in whole]


def table_digest(table: DataFrame, *by: str) -> DataFrame:
    """(by, rows, digest): the multiset of rows of each group, or of the whole table."""
    rows = table.select(*by, row_digest(table).alias("_h"))
    sums = rows.groupBy(*by).agg(F.count("*").alias("rows"), *(F.sum(c).alias(k) for k, c in digest_halves(F.col("_h")).items()))
    parts = joined_halves([F.col(f"_p{k}") for k in range(2 * _PARTS)])
    return sums.select(*by, "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *parts), 256).alias("digest"))


def coverage(records: DataFrame, failures: DataFrame, index: DataFrame, evaluators: Iterable[str] | None = None) -> DataFrame:
    """The account of each evaluator with ``not_run``, the planned cases without an outcome, and ``amiss``: rows that are foreign, repeated or clash."""
    rows = accounting(records, failures, index, evaluators)
    return rows.select("evaluator_name", "planned", "scored", "failed", F.col("missing").alias("not_run"), (F.col("foreign") + F.col("repeated") + F.col("clashing")).alias("amiss"))


def _binding(table: DataFrame | None) -> dict:
    if table is None:
        return {"present": False, "rows": 0, "digest": None}
    return {"present": True, **table_digest(table).first().asDict()}


def _metrics(records: DataFrame, measure: Callable[[DataFrame], DataFrame]) -> dict[str, dict]:
    """Metrics by evaluator: a row for each evaluator reaches the driver."""
    return {r["evaluator_name"]: {k: v for k, v in r.asDict().items() if k != "evaluator_name"} for r in measure(records).collect()}


def _coverage(records: DataFrame, failures: DataFrame, index: DataFrame, metrics: dict[str, dict]) -> dict[str, dict]:
    """The account by evaluator, of those with metrics, which are all that have records, and of those that only failed."""
    names = {*metrics, *(r["evaluator_name"] for r in failures.select("evaluator_name").distinct().collect())}
    return {r["evaluator_name"]: r.asDict() for r in coverage(records, failures, index, names).collect()}


def _failures(records: DataFrame, failures: DataFrame | None) -> DataFrame:
    return failures if failures is not None else records.select("evaluator_name", "case_id", F.lit("failed").alias("status")).limit(0)


def document(records: DataFrame, failures: DataFrame | None, index: DataFrame, given: dict[str, dict] | None = None, measure: Callable[[DataFrame], DataFrame] = metric_bundle) -> dict:
    """The analysis of ``records``; ``given`` is a coverage to publish in place of the one that the tables have.

    Raises unless planned = scored + failed + not_run for every evaluator, and an evaluator has both coverage and metrics.
    """
    metrics = _metrics(records, measure)
    seen = _coverage(records, _failures(records, failures), index, metrics)
    for name, row in seen.items():
        if row["amiss"]:
            raise AnalysisError(f"{name}: {row['amiss']} outcomes are foreign, repeated or both scored and failed")
    told = given if given is not None else {name: {k: row[k] for k in COVERAGE} for name, row in seen.items()}
    for name, row in told.items():
        if set(row) != set(COVERAGE) or any(isinstance(v, bool) or not isinstance(v, int) for v in row.values()):
            raise AnalysisError(f"{name}: coverage is {', '.join(COVERAGE)}")
        if row["planned"] != row["scored"] + row["failed"] + row["not_run"]:
            raise AnalysisError(f"{name}: {row['planned']} planned, but {row['scored']} scored, {row['failed']} failed and {row['not_run']} not run")
    # an evaluator whose every case failed has no records, and no metrics
    if set(told) != set(seen) or not set(metrics) <= set(told):
        raise AnalysisError("coverage and metrics are of different evaluators")
    return {"schema": SCHEMA, "version": VERSION, "records": _binding(records), "outcomes": _binding(failures), "evaluators": sorted(told), "coverage": told, "metrics": metrics}


def publish(path: str, spark: SparkSession, made: dict) -> str:
    """Writes an analysis below ``path``, whole or not at all, and retires those of other versions; returns its folder."""
    files = spark._jvm.org.apache.hadoop.fs.Path
    root = files(path)
    system = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    target, staged, former = (files(root, n) for n in (f"analysis-v{made['version']}", f".staged-{uuid.uuid4().hex}", f".former-{uuid.uuid4().hex}"))
    spark.createDataFrame([(json.dumps(made, sort_keys=True),)], "value string").coalesce(1).write.text(staged.toString())
    if system.exists(target):
        system.rename(target, former)
    if not system.rename(staged, target):
        if system.exists(former):
            system.rename(former, target)
        raise AnalysisError(f"{path}: the analysis cannot be moved to its place")
    for old in system.listStatus(root):
        name = old.getPath().getName()
        if name.startswith(".former-") or (name.startswith("analysis-v") and name != target.getName()):
            system.delete(old.getPath(), True)
    return target.toString()


def read(path: str, spark: SparkSession) -> dict:
    """The analysis in a folder; another schema or version is an error, as its metrics may mean something else."""
    lines = spark.read.text(path).limit(2).collect()
    try:
        made = json.loads(lines[0]["value"]) if len(lines) == 1 else None
    except json.JSONDecodeError:
        made = None
    if not isinstance(made, dict):
        raise AnalysisError(f"{path}: no analysis")
    if (made.get("schema"), made.get("version")) != (SCHEMA, VERSION):
        raise AnalysisError(f"{path}: schema {made.get('schema')}, version {made.get('version')}; compute it again")
    names = made.get("evaluators")
    if not isinstance(names, list) or not names or names != sorted(set(map(str, names))) or set(names) != set(made.get("coverage") or {}):
        raise AnalysisError(f"{path}: evaluators are a sorted list of different names, each with its coverage")
    return made


def measured(records: DataFrame, failures: DataFrame | None, measure: Callable[[DataFrame], DataFrame] = metric_bundle) -> dict:
    """Bindings and metrics of tables: all of an analysis that does not depend on an index."""
    return {"records": _binding(records), "outcomes": _binding(failures), "metrics": _metrics(records, measure)}


def problems(
    made: dict, records: DataFrame, failures: DataFrame | None, index: DataFrame, measure: Callable[[DataFrame], DataFrame] = metric_bundle, own: dict | None = None,
) -> list[tuple[str, str]]:
    """(what does not agree, evaluator or an empty string) of an analysis against tables; none if everything is as it was.

    ``own`` is what :func:`measured` gives of these records and failures, for several indexes against the same tables.
    """
    out, own = [], own if own is not None else measured(records, failures, measure)
    for name in ("records", "outcomes"):
        now, then = own[name], made.get(name) or {}
        out += [(f"{name}.{k}", "") for k in ("present", "rows", "digest") if now[k] != then.get(k)]
    failed = _failures(records, failures)
    if failed.where(~F.col("status").eqNullSafe("failed")).take(1):
        out.append(("outcomes.status", ""))
    metrics = own["metrics"]
    seen = _coverage(records, failed, index, metrics)
    for name in sorted(set(seen) | set(made["coverage"])):
        now, then = seen.get(name), made["coverage"].get(name)
        if now is None or then is None:
            out.append(("evaluators", name))
            continue
        if now["amiss"]:
            out.append(("outcomes.amiss", name))
        out += [(f"coverage.{k}", name) for k in COVERAGE if now[k] != then.get(k)]
    out += [("metrics", name) for name in sorted(set(metrics) | set(made["metrics"])) if metrics.get(name) != made["metrics"].get(name)]
    return out


def verified(
    path: str, spark: SparkSession, records: DataFrame, failures: DataFrame | None, index: DataFrame, measure: Callable[[DataFrame], DataFrame] = metric_bundle, own: dict | None = None,
) -> dict:
    """The analysis in a folder, if the tables give it again, each case having an outcome; raises otherwise."""
    made = read(path, spark)
    found = problems(made, records, failures, index, measure, own) + [("coverage.not_run", name) for name, row in made["coverage"].items() if row["not_run"]]
    if found:
        raise AnalysisError(f"{path}: " + ", ".join(f"{what} of {name}" if name else what for what, name in found))
    return made
