"""Cross-entropy difference between a target and a background n-gram model.

Two bigram models are matched: one vocabulary (every word of the corpus, in lower case), one smoothing, exact counts.  The target model
counts the documents marked as target, the background model all others; a document is scored by counts without its own, so neither model
has seen it, but a copy of it elsewhere counts.  p(word | previous) = (c(previous, word) + LEAN / V) / (c(previous) + LEAN),
with V the size of the vocabulary, the exact number of different word hashes.

1. Words and pairs that may make up one in HOT tokens are found from what is frequent in any stretch of texts; they are counted
   exactly and broadcast (at most 2 * HOT of each), so no bucket of hashes gets all occurrences of one.
2. Every document's other pairs and previous words go, as 64-bit hashes with their number in the document, to the bucket of the hash; a
   stretch of documents sends one packed block to each bucket.  A bucket adds up exact counts of its hashes, and
   answers each stretch with sums per document.  Counts grow with the corpus and are never cut off.
3. The answers of a stretch meet its list of documents, and give the scores.  Gains are whole multiples of 2 ** -24 nats, so their sums are exact and no layout moves a score.

score = target cross-entropy less background cross-entropy, in nats per token; lower is closer to the target.
Defined results: texts without words, and null texts, score 0 with n_tokens 0; null ids are scored and belong to the background; rows that
share an id are documents of their own, all target if the id is; repeated rows count each time, as copies of each other; texts of any length count whole (a very long
one is a stretch of its own); ties have no influence; an empty table gives an empty result; without target documents the target model is
uniform; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import spent, written

#: Pseudo-counts of a history, spread over the vocabulary.
LEAN = 50.0
#: What makes up one in so many tokens is broadcast.
HOT = 100_000
#: Tokens of a stretch, entries of a bucket, target ids that are broadcast.
STRETCH, BUCKET, FEW = 600_000, 1_000_000, 4_000_000
#: Parts of a nat in which gains are added up.
UNIT = 1 << 24
#: The word before a text.
START = 1 << 62


class _Ids(dict):
    """Word to its hash, remembered up to 400,000 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashed = _Ids()


def word_hashes(text: bytes | None) -> np.ndarray:
    words = (text or b"").lower().split()
    return np.fromiter(map(_hashed.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Stretch:
    """Tokens of some documents: ``doc`` (number in the stretch) of each, and the hashes of the word, of the pair (even) and of the previous word (odd)."""

    def __init__(self, texts: list[bytes | None]):
        words = [word_hashes(t) for t in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.doc = np.repeat(np.arange(len(words)), self.sizes)
        self.word = np.concatenate([np.empty(0, np.uint64), *words])
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        first = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        before[first] = START
        self.before = _mixed(before + np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        self.pair = _mixed(_mixed(before * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) + self.word) & ~np.uint64(1)


def _stretches(batches, columns: list[int]):
    """Lists of rows of some tokens; texts are the first of the columns."""
    held, size = [], 0
    for batch in batches:
        cols = [batch.column(0).cast(pa.binary()).to_pylist(), *(batch.column(k).to_pylist() for k in columns[1:])]
        for row in zip(*cols):
            held.append(row)
            size += len(row[0] or b"") // 5
            if size >= STRETCH:
                yield held
                held, size = [], 0
    if held:
        yield held


def _frequent(rows: DataFrame) -> DataFrame:
    """(kind, key, n): 0 and 1 for previous words and pairs that are frequent in a stretch, 2 for its different words, 3 for its tokens."""

    def run(batches):
        for held in _stretches(batches, [0]):
            s = Stretch([r[0] for r in held])
            least = max(3, len(s.word) // HOT)
            out = [(np.full(1, 3), np.zeros(1, np.uint64), np.full(1, len(s.word)))]
            for kind, keys in ((0, s.before), (1, s.pair)):
                found, n = np.unique(keys, return_counts=True)
                ok = n >= least
                out.append((np.full(ok.sum(), kind), found[ok], n[ok]))
            words = np.unique(s.word)
            out.append((np.full(len(words), 2), words, np.ones(len(words), np.int64)))
            kind, key, n = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

    return rows.select("text").mapInArrow(run, "kind int, key long, n long")


def _hot_counts(rows: DataFrame, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact counts of ``keys`` in (background, target) documents."""
    shared = rows.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        known = shared.value
        total = np.zeros((2, len(known)), np.int64)
        for held in _stretches(batches, [0, 1]):
            s = Stretch([r[0] for r in held])
            target = np.array([r[1] for r in held], bool)[s.doc]
            for found in (s.before, s.pair):
                at = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
                ok = known[at] == found if len(known) else np.zeros(len(found), bool)
                for t in (0, 1):
                    total[t] += np.bincount(at[ok & (target == t)], minlength=len(known))
        some = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], ["k", "b", "t"])

    # at most 4 * HOT rows, added up before they reach the driver
    out = np.zeros((2, len(keys)), np.int64)
    for r in rows.select("text", "target").mapInArrow(run, "k long, b long, t long").groupBy("k").agg(F.sum("b").alias("b"), F.sum("t").alias("t")).toLocalIterator():
        out[:, r["k"]] = r["b"], r["t"]
    return out[0], out[1]


_ZIP = zstandard.ZstdCompressor(level=1)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length as bytes: of sorted or small numbers the high bytes take next to nothing."""
    return _ZIP.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns))


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for kind, width in zip(kinds, widths):
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).reshape(-1))
        at += n * width
    return out


class Gains:
    """What the counts of a pair or previous word add to log p over a pair that was never seen."""

    def __init__(self, size: float):
        self.unit = LEAN / max(size, 1.0)

    def of(self, count: np.ndarray, is_history: np.ndarray) -> np.ndarray:
        """In units of 1 / UNIT, rounded."""
        return np.rint(UNIT * np.where(is_history, -np.log1p(count / LEAN), np.log1p(count / self.unit)))


def _asked(rows: DataFrame, bits: int, hot: tuple, gains: Gains) -> DataFrame:
    """(bucket, stretch, blob): blocks of (hash, number of the document and whether it is target, times in it) for the buckets, and with a bucket below 0
    the list of a stretch's documents: id, tokens and the sums of what is hot."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        known, background, target = shared.value
        part = TaskContext.get().partitionId()
        for number, held in enumerate(_stretches(batches, [0, 1, 2])):
            s, name = Stretch([r[0] for r in held]), part << 32 | number
            of_target = np.array([r[1] for r in held], bool)
            keys, doc = np.concatenate([s.before, s.pair]), np.concatenate([s.doc, s.doc])
            order = np.lexsort((doc, keys))
            keys, doc = keys[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])) if len(keys) else np.empty(0, np.int64)
            times = np.diff(np.append(new, len(keys)))
            keys, doc = keys[new], doc[new]
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            is_hot = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            own, history = times[is_hot], (keys[is_hot] & np.uint64(1)).astype(bool)
            mine = of_target[doc[is_hot]]
            sums = [
                np.bincount(doc[is_hot], own * gains.of(count[at[is_hot]] - own * (mine == t), history), len(held)).astype(np.int64) for t, count in ((1, target), (0, background))
            ]
            keys, doc, times = keys[~is_hot], doc[~is_hot], times[~is_hot]
            info = _packed(np.array([r[2] or 0 for r in held], np.int64), np.array([r[2] is None for r in held], np.uint8), s.sizes, *sums)
            ends = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(1, 1 << bits).astype(np.uint64)) if bits else []
            cuts = [0, *ends, len(keys)]
            some = [b for b in range(len(cuts) - 1) if cuts[b + 1] > cuts[b]]
            blocks = [_packed(keys[a:z], (doc[a:z] << 1 | of_target[doc[a:z]]).astype(np.uint32), times[a:z].astype(np.uint32)) for a, z in ((cuts[b], cuts[b + 1]) for b in some)]
            # documents go to as many places as there are buckets, too
            yield pa.RecordBatch.from_arrays([pa.array([-1 - name % (1 << bits), *some], pa.int64()), pa.array([name] * (len(some) + 1), pa.int64()), pa.array([info, *blocks], pa.binary())], ["bucket", "stretch", "blob"])

    return rows.select("text", "target", "doc_id").mapInArrow(run, "bucket long, stretch long, blob binary")


def _answered(asked: DataFrame, gains: Gains) -> DataFrame:
    """(stretch, kind, blob): lists of documents (kind 0) as they came, and the answers of the buckets (kind 1): document, gains under target and background."""

    def answers(blocks):
        parts = [_unpacked(b, "<u8", "<u4", "<u4") for _, b in blocks]
        which = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        keys, doc, times = (np.concatenate(c) for c in zip(*parts))
        _, at = np.unique(keys, return_inverse=True)
        of_target, history = (doc & 1).astype(bool), (keys & np.uint64(1)).astype(bool)
        sums = []
        for t in (True, False):
            mine = np.where(of_target == t, times, 0)
            count = np.bincount(at, mine)[at] - mine
            sums.append(np.where(count > 0, times * gains.of(count, history), 0.0))
        some = (sums[0] != 0) | (sums[1] != 0)
        place = which[some] << 32 | (doc[some] >> np.uint32(1)).astype(np.int64)
        found, back = np.unique(place, return_inverse=True)
        added = [np.bincount(back, x[some], len(found)).astype(np.int64) for x in sums]
        cuts = np.searchsorted(found >> 32, np.arange(len(blocks) + 1))
        for k, (name, _) in enumerate(blocks):
            a, z = cuts[k], cuts[k + 1]
            if z > a:
                yield name, 1, _packed((found[a:z] & 0xFFFFFFFF).astype(np.uint32), added[0][a:z], added[1][a:z])

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(3)))

        for bucket, group in itertools.groupby(rows(), key=lambda r: r[0]):
            found = [(name, 0, blob) for _, name, blob in group] if bucket < 0 else list(answers([(name, blob) for _, name, blob in group]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.binary()))], ["stretch", "kind", "blob"])

    return asked.repartition("bucket").sortWithinPartitions("bucket", "stretch").mapInArrow(run, "stretch long, kind int, blob binary")


def _scored(answered: DataFrame, gains: Gains) -> DataFrame:
    unseen = float(np.log(gains.unit / LEAN))

    def run(batches):
        held = None

        def finished():
            ids, missing, n, target, background = held
            ce = [np.where(n > 0, -(s / UNIT / np.maximum(n, 1) + unseen), 0.0) for s in (target, background)]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=missing.astype(bool)), pa.array(n), pa.array(ce[0]), pa.array(ce[1]), pa.array(ce[0] - ce[1])], ["doc_id", "n_tokens", "target_ce", "background_ce", "score"]
            )

        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kind == 0:
                    if held is not None:
                        yield finished()
                    held = _unpacked(blob, "<i8", "<u1", "<i8", "<i8", "<i8")
                else:
                    doc, target, background = _unpacked(blob, "<u4", "<i8", "<i8")
                    held[3][doc] += target
                    held[4][doc] += background
        if held is not None:
            yield finished()

    # a stretch's list comes before its answers, and these in an order that does not change
    rows = answered.repartition("stretch").sortWithinPartitions("stretch", "kind", F.xxhash64("blob"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, target_ce double, background_ce double, score double")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, target_ce, background_ce, score.

    ``target_ids`` (doc_id) marks the target documents.
    """
    marks = written(target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("target", F.lit(True)), "targets")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if marks.count() <= FEW:
        rows = rows.join(F.broadcast(marks), "doc_id", "left")
    else:  # a shuffle deals rows out in any order; a stretch must be the same again if a task is repeated
        rows = rows.join(marks, "doc_id", "left").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    rows = rows.withColumn("target", F.coalesce("target", F.lit(False)))

    frequent = written(_frequent(rows), "frequent")
    total = frequent.where("kind = 3").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    vocabulary = frequent.where("kind = 2").select("key").distinct().count()
    # their occurrences add up to the tokens at most, so there are no more than 2 * HOT of a kind
    often = frequent.where("kind < 2").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") * (2 * HOT) >= total).select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64)
    spent(frequent)
    keys, gains = np.sort(often), Gains(float(vocabulary))
    hot = (keys, *_hot_counts(rows, keys))
    bits = max(0, int(np.ceil(np.log2(max(1.2 * total / BUCKET, 1)))))
    return _scored(_answered(_asked(rows, bits, hot, gains), gains), gains)
