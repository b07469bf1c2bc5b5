"""Ordinal quality classifier: cumulative-link regression on graded ratings.

Ratings have three grades: 0 low quality, 1 well formed but toxic, 2 good.  One vector
of weights on hashed text is shared by all thresholds; ordered thresholds turn the
margin into P(grade >= 1) and P(grade >= 2), and the likelihood of a grade is the difference of
neighbouring tails.  Features are the distinct words and word
beginnings of a text, the shares of its token shapes, and coarse bins of length and
repetition.

At most ``max_rows`` rated rows are used for fitting, never those held out (as in
:mod:`assay.llm.toxicity`), so quality can be measured on the rest.
Defined results: null and empty texts get the grade of a text without words; rows without a rating are not fitted, and
neither are null ids; an id with several ratings has the lowest; repeated rows repeat, and repeated training rows count
each time; equal margins get equal grades; very long texts count whole; an empty table gives an empty result; without any
rating every document has the prior of equal grades; extra columns are ignored; results do not depend on the layout of the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.hashed_text import Features, bucket, shapes, stretches
from assay.llm.linear import Ordinal, fit, labelled_sample
from assay.llm.toxicity import held_out

MAX_ROWS = 20_000
GRADES = 3
#: Weights of the kinds of features in a margin.
SHAPE, WORD = 3.0, 0.3
_BINS = {name: np.array([bucket(f"{name} {k}") for k in range(64)]) for name in ("bias", "length", "distinct", "same")}


class _Counted:
    """Terms, shape shares and bins of some texts."""

    def __init__(self, texts: list[str]):
        self.f = f = Features(texts)
        n = np.bincount(f.token_doc, minlength=f.n)
        self.share = SHAPE / np.maximum(n, 1)
        self.shape = shapes(f.tokens)[f.token] if len(f.token) else np.zeros(0, np.int64)
        distinct = np.bincount(np.unique(f.token_doc * max(len(f.tokens), 1) + f.token) // max(len(f.tokens), 1), minlength=f.n)
        follows = (f.token_doc[1:] == f.token_doc[:-1]) & (f.token[1:] == f.token[:-1])
        same = np.bincount(f.token_doc[1:][follows], minlength=f.n)
        length = np.frexp(n.astype(float))[1]
        parts = {"bias": n * 0, "length": np.minimum(length, 63), "distinct": 10 * distinct // np.maximum(n, 1), "same": 10 * same // np.maximum(n, 1)}
        self.bins = np.stack([_BINS[name][k] for name, k in parts.items()], 1) if f.n else np.zeros((0, 4), np.int64)

    def margins(self, weights: np.ndarray) -> np.ndarray:
        f = self.f
        return WORD * f.sums(weights) + self.share * np.bincount(f.token_doc, weights[self.shape], f.n) + weights[self.bins].sum(1)

    def rows(self) -> list[tuple[np.ndarray, np.ndarray]]:
        f, out = self.f, []
        by_text = np.split(self.shape, np.searchsorted(f.token_doc, np.arange(1, f.n)))
        for terms, shape, share, bins in zip(f.rows(), by_text, self.share, self.bins):
            kinds, counts = np.unique(shape, return_counts=True)
            out.append((np.concatenate([terms, kinds, bins]), np.concatenate([np.full(len(terms), WORD), share * counts, np.ones(len(bins))])))
        return out


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and values of each text: shapes weigh by their share of the tokens, words and bins count once."""
    return [row for part in stretches(texts) for row in _Counted(part).rows()]


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from (doc_id, quality, toxic); rows whose labels do not decide a grade are not rated."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade")).where("grade is not null")


def train(docs: DataFrame, rated: DataFrame, max_rows: int = MAX_ROWS) -> Ordinal:
    sample = labelled_sample(docs, rated.where(~held_out(F.col("doc_id"))), F.min("grade"), max_rows, "rated-sample")
    return fit(sample, GRADES, lambda grades: np.eye(GRADES)[grades.astype(int)], features, rounds=3, epochs=3, rate=0.3, l1=0.5)


def graded(docs: DataFrame, rated: DataFrame, max_rows: int = MAX_ROWS, least_tail: float = 0.5, grade: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, expected_grade, p_ge_1, p_ge_2, kept (P(grade >= ``grade``) >= ``least_tail``)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = docs.sparkSession.sparkContext.broadcast(train(rows, rated, max_rows))

    def run(batches):
        m = model.value
        for batch in batches:
            margins = [_Counted(part).margins(m.weights) for part in stretches(batch.column(1).to_pylist())]
            tails = m.tails(np.concatenate([np.zeros(0), *margins]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(tails[:, k]) for k in range(GRADES - 1))], ["doc_id", "p_ge_1", "p_ge_2"])

    out = rows.mapInArrow(run, "doc_id long, p_ge_1 double, p_ge_2 double")
    return out.select("doc_id", (F.col("p_ge_1") + F.col("p_ge_2")).alias("expected_grade"), "p_ge_1", "p_ge_2", (F.col(f"p_ge_{grade}") >= least_tail).alias("kept"))
