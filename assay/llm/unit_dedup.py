"""Substring dedup by hashing text units: lines broken at sentence ends (the default), whole lines, or paragraphs.

Units are normalised (lower case, single blanks) and hashed to 128 bits; the digests
are grouped over the whole table; of each digest the earliest occurrence, by
(doc_id, hash of the text, position), stays and the others are repeats.  Consecutive repeats of a
document are merged, and a run of them is removed if it has at least
``min_run_words`` words.  Lines broken at sentence ends find a repeated passage also where it was put
inside a line; a repeated line or paragraph is a run of such units.

Offsets count code points of the original text and are kept with every unit.  A row is known by its id and the hash of its
text (``content``), so rows that share an id, or have none, keep their own spans.
Defined results: null and blank texts have no units; a null id ranks before all
others; rows of one id and one text count as one document; units under ``min_unit_words``
words neither start nor break a run; very long texts count whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import written

#: What separates units.
BREAKS = {
    "sentence": re.compile(r"\n+|(?<=[.!?])[ \t]+"),
    "line": re.compile(r"\n"),
    "paragraph": re.compile(r"\n[ \t]*\n\s*"),
}


def text_units(text: str, kind: str = "sentence", min_unit_words: int = 3) -> list[tuple[int, int, int, str]]:
    """(begin, end, words, normalised text) of the units of a text that have enough words."""
    found, at = [], 0
    for gap in [m.span() for m in BREAKS[kind].finditer(text)] + [(len(text), len(text))]:
        words = text[at : gap[0]].lower().split()
        if len(words) >= min_unit_words:
            found.append((at, gap[0], len(words), " ".join(words)))
        at = gap[1]
    return found


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "sentence", min_unit_words: int = 3) -> DataFrame:
    """A row for each unit: doc_id, content, pos, begin, end, n_words, h1, h2 (its digest)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                cols = [[] for _ in range(8)]
                for doc_id, content, text in zip(*(batch.column(k)[at : at + 500].to_pylist() for k in range(3))):
                    for pos, (begin, end, n, normal) in enumerate(text_units(text or "", kind, min_unit_words)):
                        h = xxhash.xxh3_128_intdigest(normal)
                        for col, value in zip(cols, (doc_id, content, pos, begin, end, n, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63))):
                            col.append(value)
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "content", "pos", "begin", "end", "n_words", "h1", "h2"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("content"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, content long, pos int, begin int, end int, n_words int, h1 long, h2 long")


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "sentence", min_unit_words: int = 3, min_run_words: int = 20,
) -> DataFrame:
    """A row for each span to remove: doc_id, content, begin, end, n_units, n_words, first_doc_id (where its first unit stays)."""
    every = written(units(docs, id_col, text_col, kind, min_unit_words), "units")
    place = F.struct("doc_id", "content", "pos")
    firsts = every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeats = every.join(firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    row = ["doc_id", "content"]
    repeats = repeats.select(*row, "pos", "begin", "end", "n_words", F.col("first.doc_id").alias("first_doc_id")).dropDuplicates([*row, "pos"])
    order = Window.partitionBy(*row).orderBy("pos")
    runs = repeats.withColumn("run", F.col("pos") - F.row_number().over(order))
    runs = runs.groupBy(*row, "run").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").alias("n_units"),
        F.sum("n_words").alias("n_words"), F.min_by("first_doc_id", "pos").alias("first_doc_id"),
    )
    return runs.where(F.col("n_words") >= min_run_words).select(*row, "begin", "end", "n_units", "n_words", "first_doc_id")


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans (doc_id, content: xxhash64 of the text, begin, end) cut out of their texts; all columns and rows stay.

    Spans may touch or overlap.
    """
    before = Window.partitionBy("doc_id", "content").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    # of each cut: where the text that is kept before it begins
    cuts = spans.select("doc_id", "content", "begin", "end").distinct().withColumn("kept", F.coalesce(F.max("end").over(before), F.lit(0)))
    cuts = cuts.groupBy(F.col("doc_id").alias("__id"), F.col("content").alias("__content")).agg(F.sort_array(F.collect_list(F.struct("begin", "kept"))).alias("__cuts"), F.max("end").alias("__end"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__content"))
    text = F.col(text_col)
    pieces = F.transform("__cuts", lambda c: F.substring(text, c.kept + 1, F.greatest(c.begin - c.kept, F.lit(0))))
    left = F.concat(F.array_join(pieces, ""), F.substring(text, F.col("__end") + 1, F.greatest(F.length(text) - F.col("__end"), F.lit(0))))
    out = docs.join(cuts, same, "left")
    return out.withColumn(text_col, F.when(F.col("__cuts").isNull(), text).otherwise(left)).select(docs.columns)
