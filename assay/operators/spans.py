"""Spans of documents that an edit may touch: a span is a row that says which text it was taken from, and is checked against the text before it is used.

A span holds the identity of its document (SHA-256 of the text), its lines, heading, level and own text.  It is authorised if the document still has that
identity, the lines lie inside it and build the span's text again, and the first line is its heading (or the span begins the document and has none).

Defined results: a span of an unknown document is foreign; a null text is no document; repeated spans are checked each time; of several faults the first one is named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions import text as T
from assay.functions.hashing import document_identity
from assay.operators.integrity import require_none

#: Faults in the order in which they are looked for.
FOREIGN, STALE, OUTSIDE, OTHER_TEXT, OTHER_HEADING = "foreign", "stale", "outside", "other_text", "other_heading"


def captured(reports: DataFrame, key: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """A span for every section of ``reports``: key, identity, ordinal, heading, level, start_line, end_line, text."""
    rows = T.with_sections(reports.select(key, text_col, document_identity(F.col(text_col)).alias("identity")), text_col)
    return T.exploded(rows.select(key, "identity", "sections"), "sections").select(key, "x.*", "identity")


def checked(spans: DataFrame, reports: DataFrame, key: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """``spans`` with ``fault``, NULL where a span is authorised in ``reports``; a text is split once for all its spans, and leaves no trace."""
    now = reports.where(F.col(text_col).isNotNull()).select(F.col(key), T.lines(F.col(text_col)).alias("_lines"), document_identity(F.col(text_col)).alias("_now"))
    rows = spans.join(now, key, "left")
    a, z = F.col("start_line"), F.col("end_line")
    inside = F.coalesce((a >= 1) & (a <= z) & (z <= F.size("_lines")), F.lit(False))
    built = F.btrim(F.array_join(F.slice("_lines", F.greatest(a, F.lit(1)), F.greatest(z - a + 1, F.lit(0))), "\n"), F.lit("\n"))
    first = F.get("_lines", a - 1)
    headed = F.coalesce(first.rlike(T.HEADING) & (F.trim(F.regexp_extract(first, T.HEADING, 2)) == F.col("heading")) & (F.length(F.regexp_extract(first, T.HEADING, 1)) == F.col("level")), F.lit(False))
    right = F.when(F.col("heading").isNull(), a == 1).otherwise(headed)
    fault = (
        F.when(F.col("_now").isNull(), FOREIGN).when(~F.col("identity").eqNullSafe(F.col("_now")), STALE).when(~inside, OUTSIDE).when(~built.eqNullSafe(F.col("text")), OTHER_TEXT).when(~right, OTHER_HEADING)
    )
    return rows.withColumn("fault", fault).select(*spans.columns, "fault")


def authorised(spans: DataFrame, reports: DataFrame, key: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """``spans``, if all of them are; an edit reads its spans through this."""
    found = checked(spans, reports, key, text_col)
    require_none(found.where("fault is not null").select(key, "start_line", "fault"), "a span is not what it was")
    return spans
