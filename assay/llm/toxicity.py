"""Toxicity by weak supervision.

1. Voters: words and word beginnings that labelled training documents suggest (a
   lexicon), patterns of these terms (several terms, a dense text of terms), and patterns that owe
   nothing to the labels (shouting, address in the second person, calls, masked words).  Each votes or
   abstains on a document.
2. A generative label model sees only the votes: expectation maximisation estimates
   how often each voter fires in toxic and other documents, and in each class the correlations of the voters;
   voters that repeat each other share their weight.
3. A linear classifier on hashed words is trained on the model's posterior labels.
4. Its margin is calibrated on the training labels.

Training uses at most ``max_rows`` labelled rows, never those held out (crc32 of the
doc_id as text, modulo 4, is 2); inputs of a score are texts alone.
Defined results: null and empty texts get the score of a text without evidence; rows
with null labels or ids train nothing; an id with several labels is toxic if one says so; repeated rows repeat, and
repeated training rows count each time; equal texts get equal scores; very long texts count whole; an empty table gives an
empty result; without any labels all scores are 0; extra columns are ignored; results do not depend on the layout of the input.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import written
from assay.llm.hashed_text import STARTS, TIERS, Features, stretches
from assay.llm.hashed_text import TRIM as _TRIM
from assay.llm.linear import Ordinal, fit, in_order, labelled_sample

MAX_ROWS = 20_000
#: Terms of the lexicon at most; documents and share of toxic documents that a term needs.
TERMS, LEAST_DOCS, LEAST_SHARE = 400, 5, 0.7
#: Correlation within a class below which voters count as independent.
REPEATS = 0.5
#: Voters behind those of the lexicon.
PATTERNS = 8
_CALLS, _MASKED = re.compile(r"[!?]{2,}|!"), re.compile(r"[^\W\d_][*#@$%]{2,}|[^\W\d_][*#@$%]+[^\W\d_]")
_SECOND = re.compile(r"\b(you|your|du|dein|tu|vous|ton|usted|eres)\b", re.I)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


@functools.lru_cache(200_000)
def terms_of(token: str) -> tuple[str, ...]:
    """The word of a token, and its beginnings (marked by ``~``)."""
    word = token.strip(_TRIM)
    return (word, *(word[:n] + "~" for n in STARTS if len(word) > n)) if word else ()


def words_of(text: str) -> set[str]:
    return {t.strip(_TRIM) for t in set(text.lower().split())}


def document_terms(text: str) -> set[str]:
    """Words and beginnings of a text; with a number behind, those that so many different words share."""
    counts = Counter(t for word in words_of(text) for t in terms_of(word))
    return {*counts, *(f"{t}{k}" for t, n in counts.items() if n > 1 for k in TIERS if n >= k)}


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed terms of each text, as in :func:`document_terms`; each counts once."""
    return [(at, np.ones(len(at))) for part in stretches(texts) for at in Features(part).rows()]


def lexicon(sample: DataFrame) -> list[str]:
    """Terms that are frequent in toxic documents of ``sample`` (text, label) and rare in others, the strongest first."""

    def count(batches):
        toxic, other = Counter(), Counter()
        for batch in batches:
            for row in batch.to_pylist():
                (toxic if row["label"] else other).update(document_terms(row["text"] or ""))
                if len(toxic) + len(other) > 300_000:
                    yield _term_rows(toxic, other)
                    toxic, other = Counter(), Counter()
        if toxic or other:
            yield _term_rows(toxic, other)

    counted = sample.select("text", "label").mapInArrow(count, "term string, toxic long, other long")
    counted = counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    share = F.col("toxic") / (F.col("toxic") + F.col("other") + 1)
    best = counted.where((F.col("toxic") >= LEAST_DOCS) & (share >= LEAST_SHARE) & (F.length("term") <= 100))
    # of terms with the same counts and beginning, the shortest says it all
    best = best.groupBy(F.substring("term", 1, 3), "toxic", "other").agg(F.min_by("term", F.struct(F.length("term"), "term")).alias("term"))
    return [r["term"] for r in best.orderBy((share * F.log1p("toxic")).desc(), "term").limit(TERMS).collect()]


def _term_rows(toxic: Counter, other: Counter) -> pa.RecordBatch:
    terms = list({*toxic, *other})
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([other[t] for t in terms], pa.int64())], ["term", "toxic", "other"])


def votes(text: str, terms: list[str]) -> np.ndarray:
    """1 where a voter fires: the terms in order, then the patterns."""
    found = document_terms(text)
    fired = [t in found for t in terms]
    tokens = text.split()
    words = [t for t in terms if "~" not in t]
    hits = sum(fired)
    patterns = [hits >= 2, hits >= 4, any(t in found for t in words) and len(tokens) < 200, hits * 100 >= max(len(tokens), 1)]
    free = [bool(_SECOND.search(text)), sum(t.isupper() for t in tokens) * 2 > len(tokens), len(_CALLS.findall(text)) > 1, bool(_MASKED.search(text))]
    return np.array(fired + patterns + free, np.float64)


class LabelModel:
    """Two latent classes; voters fire with class-wise rates and are correlated within a class."""

    def __init__(self, votes: np.ndarray, prior: float, steps: int = 25):
        n, m = votes.shape
        self.prior = min(max(prior, 1e-3), 0.5)
        # start: documents with several votes are rather toxic, without any rather not
        p = np.clip(votes.sum(1) / 3, self.prior / 10, 0.95)
        for _ in range(steps):
            rate = [(q @ votes + 0.5 * base) / (q.sum() + base) for q, base in ((1 - p, 4.0), (p, 2.0))]
            self.rates = np.clip(np.array(rate), 1e-4, 1 - 1e-4)
            self.by_class = np.stack([self._within(votes, 1 - p, self.rates[0]), self._within(votes, p, self.rates[1])])
            self.correlations = np.average(self.by_class, axis=0, weights=[(1 - p).sum(), p.sum()])
            # a voter that others repeat within a class has the weight of its group, shared; weak correlations are noise
            alike = np.clip((self.by_class - REPEATS / 2) / (REPEATS / 2), 0, 1) * np.maximum(self.by_class, 0)
            self.share = (1 / np.maximum(alike.sum(2), 1)).mean(0)
            new = self.posterior(votes)
            if np.abs(new - p).max() < 1e-4:
                break
            p = new

    @staticmethod
    def _within(votes: np.ndarray, p: np.ndarray, rates: np.ndarray) -> np.ndarray:
        """Correlations of the voters in a class, of which documents are members with probabilities ``p``."""
        left = votes - rates
        cov = (left * p[:, None]).T @ left / max(p.sum(), 1)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        return cov / sd[:, None] / sd[None, :]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """A voter that does not fire abstains; the shift makes the mean posterior the share of toxic documents."""
        odds = votes @ (np.log(self.rates[1] / self.rates[0]) * self.share)
        low, high = -60.0, 60.0
        for _ in range(50):
            self.shift = (low + high) / 2
            p = 1 / (1 + np.exp(-np.clip(odds + self.shift, -30, 30)))
            low, high = (self.shift, high) if p.mean() < self.prior else (low, self.shift)
        return p


class Model:
    """What scoring needs: the linear classifier and its calibration."""

    def __init__(self, linear: Ordinal, slope: float, shift: float):
        self.weights, self.cut, self.slope, self.shift = linear.weights, float(linear.cuts[0]), slope, shift

    def margins(self, texts: list[str | None]) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(Features(part).sums(self.weights) for part in stretches(texts))]) - self.cut

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    """Fits on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), of which at most ``max_rows`` rows are used."""
    known = labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    sample = labelled_sample(docs, known, F.max(F.col("toxic").cast("int")), max_rows, "toxic-sample")
    size, positive = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not size:
        return None
    terms = lexicon(sample)

    def vote(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_order(pdf)
        return pd.DataFrame({"part": pdf["part"], "place": range(len(pdf)), "votes": [np.packbits(votes(t, terms).astype(np.uint8)).tobytes() for t in pdf["text"]]})

    # bounded: max_rows rows of some tens of bytes, in the order of the parts
    got = sorted(sample.groupBy("part").applyInPandas(vote, "part int, place int, votes binary").collect(), key=lambda r: (r["part"], r["place"]))
    matrix = np.array([np.unpackbits(np.frombuffer(r["votes"], np.uint8))[: len(terms) + PATTERNS] for r in got], np.float32)
    posterior = LabelModel(matrix, positive / size).posterior(matrix)
    spark = docs.sparkSession
    # the same rows in the same order meet their posterior by their place
    soft = {part: [float(p) for r, p in zip(got, posterior) if r["part"] == part] for part in {r["part"] for r in got}}
    taught = spark.sparkContext.broadcast(soft)

    def teach(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_order(pdf)
        return pdf.assign(gold=pdf["label"].astype("int64"), label=taught.value[int(pdf["part"].iloc[0])])

    taught_rows = written(sample.groupBy("part").applyInPandas(teach, "doc_id long, text string, label double, part int, gold long"), "toxic-taught")
    linear = fit(taught_rows.drop("gold"), 2, lambda p: np.stack([1 - p, p], 1), features, l1=4.0)
    model = spark.sparkContext.broadcast(Model(linear, 1.0, 0.0))

    def margins(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_order(pdf)
        return pd.DataFrame({"part": pdf["part"], "place": range(len(pdf)), "margin": model.value.margins(pdf["text"].tolist()), "gold": pdf["gold"]})

    pairs = sorted(taught_rows.groupBy("part").applyInPandas(margins, "part int, place int, margin double, gold long").collect(), key=lambda r: (r["part"], r["place"]))
    slope, shift = calibrated(np.array([r["margin"] for r in pairs]), np.array([r["gold"] for r in pairs], float))
    return Model(linear, slope, shift)


def calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve from margins to labels (Newton steps, ridge on the slope)."""
    scale = max(float(np.abs(margin).max()), 1e-6)
    x = np.stack([margin / scale, np.ones(len(margin))], 1)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (p - target) + np.array([1e-3, 1e-6]) * b
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(hess, grad)
        b = b - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(b[0], 1e-3) / scale), float(b[1])


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted (1 if score >= 0.3)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = docs.sparkSession.sparkContext.broadcast(train(rows, labels, max_rows))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores = model.value.scores(texts) if model.value else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
