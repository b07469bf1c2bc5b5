"""Sparse linear models on hashed text, fitted by parameter mixing on a bounded sample of rows.

Fits do not depend on the layout of the input: a row's part is a function of its id, and the rows of a part are sorted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import written
from assay.llm.hashed_text import DIM

#: Parts that fit on their own and are averaged: one for so many labels, at most eight.
PARTS, PART_ROWS = 8, 2_500
#: Bytes of the longest text that takes part in a fit, so a part holds half a gigabyte at most; scores are made of texts of any length.
FIT_BYTES = 200_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, most: int, name: str) -> DataFrame:
    """(doc_id, text, label, part) of at most ``most`` rows: the labelled ids of the least hash, and of each the text of the least hash among
    those of up to :data:`FIT_BYTES`; ``label`` is an aggregate over the rows of an id in ``labels``, so that ids with several labels have a defined one.

    The sample of labels is bounded by ``most`` rows, so it is broadcast and the texts are not shuffled.
    """
    labels = labels.where("doc_id is not null").groupBy("doc_id").agg(label.alias("label")).where("label is not null")
    few = written(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), f"{name}-labels")
    parts = max(1, min(PARTS, few.count() // PART_ROWS))
    texts = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_BYTES).join(F.broadcast(few), "doc_id")
    # an id may have any number of rows
    first = F.min_by(F.coalesce("text", F.lit("")), F.struct(F.xxhash64("text"), F.col("text")))
    out = texts.groupBy("doc_id").agg(first.alias("text"), F.first("label").alias("label"))
    return written(out.withColumn("part", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(parts)).cast("int")), name)


def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of a part sorted by id and text."""
    pdf = pdf.assign(text=pdf["text"].fillna(""))
    return pdf.sort_values(["doc_id", "text"], kind="stable").reset_index(drop=True)


class Ordinal:
    """Cumulative-link regression: P(grade >= k) = sigmoid(w . x - cut[k - 1]), cuts in order.

    One cut is logistic regression.  Targets are distributions over the grades, so soft labels fit too.
    """

    #: Least distance of neighbouring cuts.
    GAP = 1e-3

    def __init__(self, grades: int, weights: np.ndarray | None = None, cuts: np.ndarray | None = None):
        self.weights = np.zeros(DIM) if weights is None else weights
        self.cuts = np.linspace(-1.0, 1.0, grades + 1)[1:-1] if cuts is None else cuts

    def tails(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .., a row for each margin."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(margin)[..., None] - self.cuts, -40, 40)))

    def slopes(self, margin: float, target: np.ndarray) -> tuple[float, np.ndarray]:
        """Derivatives by margin and cuts of the loss - sum of target[k] * log(P(grade >= k) - P(grade >= k + 1))."""
        s = np.concatenate([[1.0], 1 / (1 + np.exp(-np.clip(margin - self.cuts, -40, 40))), [0.0]])
        share = target / np.maximum(s[:-1] - s[1:], 1e-9)
        tail = s[1:-1]
        return float(target @ (s[:-1] + s[1:] - 1)), tail * (1 - tail) * (share[1:] - share[:-1])

    def fit_part(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int, rate: float, l1: float, seed: int) -> None:
        """Follow-the-regularised-leader passes over (buckets, values, target distribution) rows; l1 keeps rare noise at zero."""
        z, n = np.zeros(DIM), np.full(DIM, 1.0)
        z -= np.where(self.weights != 0, self.weights / rate + np.sign(self.weights) * l1, 0)  # starts at the given weights
        rng, seen = np.random.default_rng(seed), 1.0
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                at, x, target = rows[k]
                w = np.where(np.abs(z[at]) <= l1, 0, -(z[at] - np.sign(z[at]) * l1) * rate / np.sqrt(n[at]))
                by_margin, by_cut = self.slopes(float(w @ x), target)
                g = by_margin * x
                new = n[at] + g * g
                z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / rate * w
                n[at] = new
                seen += 1
                self.cuts = self.cuts - np.clip(by_cut, -1, 1) * 2.0 / np.sqrt(seen + 25)
                for j in range(1, len(self.cuts)):
                    self.cuts[j] = max(self.cuts[j], self.cuts[j - 1] + self.GAP)
        self.weights = np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) * rate / np.sqrt(n))


def fit(sample: DataFrame, grades: int, targets, features, rounds: int = 3, epochs: int = 3, rate: float = 0.5, l1: float = 2.0) -> Ordinal:
    """An :class:`Ordinal` for ``sample`` (doc_id, text, label, part), already bounded.

    ``features(texts) -> [(buckets, values)]`` and ``targets(labels) -> distributions over grades`` run in the
    tasks.  In every round each part fits its own rows from the common weights; the driver
    averages vectors of fixed size.
    """
    model = Ordinal(grades)
    spark = sample.sparkSession
    for k in range(rounds):
        run = _part_fit(spark.sparkContext.broadcast((model.weights, model.cuts)), grades, targets, features, epochs, rate, l1, k)
        # a row of fixed size for each part
        parts = sorted(sample.groupBy("part").applyInPandas(run, "part int, n long, w binary, c binary").collect(), key=lambda r: r["part"])
        total = sum(r["n"] for r in parts)
        if total:
            model = Ordinal(grades, sum(np.frombuffer(r["w"], np.float32).astype(float) * r["n"] for r in parts) / total, sum(np.frombuffer(r["c"]) * r["n"] for r in parts) / total)
    return model


def _part_fit(start, grades: int, targets, features, epochs: int, rate: float, l1: float, seed: int):
    """The fit of one part's rows, from broadcast weights and cuts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_order(pdf)
        found = features(pdf["text"].tolist())
        rows = [(at, x, t) for (at, x), t in zip(found, targets(pdf["label"].to_numpy(float))) if len(at)]
        part = Ordinal(grades, start.value[0].copy(), start.value[1].copy())
        part.fit_part(rows, epochs, rate, l1, seed)
        return pd.DataFrame({"part": pdf["part"][:1], "n": [len(rows)], "w": [part.weights.astype(np.float32).tobytes()], "c": [part.cuts.tobytes()]})

    return run
