"""Two evaluators as a user would bring them, and what they must say of every document, in SQL."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc

from assay.operators.external import ATTEMPT, Failure, PerReport
from assay.schema import DIMENSIONS


class Stops:
    """Judges batches as a whole: texts with many full stops for their length are accepted."""

    name, version = "stops", "1.0"

    def evaluate(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        text = pc.fill_null(batch.column("raw_text"), "")
        stops, chars = pc.count_substring(text, "."), pc.utf8_length(text)
        share = pc.min_element_wise(pc.divide(pc.cast(stops, pa.float64()), 64.0), 1.0)
        decision = pc.if_else(pc.equal(chars, 0), "needs_manual_review", pc.if_else(pc.greater(pc.multiply(stops, 100), pc.cast(chars, pa.int32())), "accept", "reject"))
        n = batch.num_rows
        dims = pa.MapArray.from_arrays(pa.array(range(0, 5 * n + 1, 5), pa.int32()), pa.array(DIMENSIONS * n), pa.array([v for v in share.to_pylist() for _ in DIMENSIONS], pa.float64()))
        nothing = pa.nulls(n, pa.string())
        findings = pa.array([[{"code": "MANY_STOPS", "severity": "low", "evidence": "", "message": ""}] if k > 64 else [] for k in stops.to_pylist()], ATTEMPT.field("findings").type)
        columns = [batch.column("report_id"), decision, share, dims, findings, pa.array([""] * n), nothing, nothing, pa.array([1] * n, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ATTEMPT.names)


def _hasty(report: dict) -> dict:
    text = report["raw_text"] or ""
    if len(text) > 4000:
        raise Failure("deadline", "text too long", attempts=3)
    if "," not in text:
        raise Failure("parse", "parse.no_json_object")
    return {"decision": "accept" if text.count("e") > text.count("a") else "reject", "confidence": 0.25, "dimensions": dict.fromkeys(DIMENSIONS, 0.5)}


HASTY = PerReport("hasty", "2.1", _hasty)

_COUNT = "length(text) - length(replace(text, '{}', ''))"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, length(text) AS chars, {_COUNT.format('.')} AS stops, {_COUNT.format('e')} AS e, {_COUNT.format('a')} AS a, contains(text, ',') AS comma FROM d),
x AS (SELECT 'stops' AS evaluator_name, '1.0' AS version, doc_id, CASE WHEN chars = 0 THEN 'needs_manual_review' WHEN stops * 100 > chars THEN 'accept' ELSE 'reject' END AS decision, least(stops / CAST(64 AS DOUBLE), 1) AS confidence,
    least(stops / CAST(64 AS DOUBLE), 1) AS reproducibility, CASE WHEN stops > 64 THEN 1 ELSE 0 END AS n_findings, CAST(NULL AS VARCHAR) AS error_kind, CAST(NULL AS VARCHAR) AS detail FROM c
  UNION ALL SELECT 'hasty', '2.1', doc_id, CASE WHEN chars > 4000 OR NOT comma THEN NULL WHEN e > a THEN 'accept' ELSE 'reject' END, CASE WHEN chars > 4000 OR NOT comma THEN NULL ELSE 0.25 END,
    CASE WHEN chars > 4000 OR NOT comma THEN NULL ELSE 0.5 END, CASE WHEN chars > 4000 OR NOT comma THEN NULL ELSE 0 END, CASE WHEN chars > 4000 THEN 'deadline' WHEN NOT comma THEN 'parse' END,
    CASE WHEN chars > 4000 THEN 'text too long' WHEN NOT comma THEN 'parse.no_json_object' END FROM c)
"""
