"""Phrases that occur more often together than their parts, mined with hashed buckets.

1. A pass over the texts counts words exactly and adds every pair of neighbours to a bucket of its hash.  Each further pass, for phrases of 2, 3 and 4
   words, counts exactly only those that can be frequent: both parts of one word less are frequent (Apriori), and the phrase's bucket is.  While it does so it
   fills the buckets of the next length with phrases whose two parts are still possible.
2. What a pass needs of the one before are two bitmaps: of hashes of the frequent phrases and of full buckets.  They are broadcast and never
   larger than ``2 ** MOST_BITS`` bits; a bit too many costs counting, never a result, as counts are exact and are compared in the end.
3. Candidates meet the counts of their parts by joins, take the cut of the lowest score, and go where a longer candidate explains them.

Buckets hold up to ``least`` and no more, so sums of tasks are one byte each.  Stretches of texts of one language are counted at a time by codes of
Arrow dictionaries, so no count depends on a hash.

Defined results: null texts count as empty, a null language is ``und``; repeated rows count each time; ties of cuts go to the shortest first part,
of phrases to the higher count and then to the smaller phrase in byte order; texts of any length count whole; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import spent, written

#: Bytes of text of one language that are counted together, and bytes held for all languages.
STRETCH, HELD = 8 << 20, 32 << 20
#: Bits of the largest bitmap (2 ** 28: 32 MB), those of the buckets of a block, and tokens for a bucket.
MOST_BITS, RANGE_BITS, LOAD = 28, 18, 4
#: Rows of a task that ranks.
PER_TASK = 200_000
BREAKS = b".,;:!?\n\x0b\x0c\r"
_TO = bytes(10 if b in BREAKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hashes of its words before the last and of the last."""
    return _mixed(a * np.uint64(0x9E3779B97F4A7C15) + b)


class Stretch:
    """Words of some texts of one language in order: ``word`` (code), ``place`` (of each in the text, with gaps where a piece ends), ``words`` (the different ones) and ``hash``."""

    def __init__(self, lang: str, texts: list[bytes]):
        blob = b"\n".join(texts).translate(_TO).replace(b"\n", b" \n ")
        coded = pc.split_pattern(pa.array([blob], pa.large_binary()), " ").flatten().dictionary_encode()
        self.lang, self.words = lang, coded.dictionary.to_pylist()
        code = coded.indices.to_numpy().astype(np.int64)
        no_word = np.array([w in (b"", b"\n") for w in self.words], bool)
        ends = np.array([w == b"\n" for w in self.words], bool)
        some = ~no_word[code]
        self.word = code[some]
        self.place = (np.cumsum(ends[code]))[some]
        salt = xxhash.xxh3_64_intdigest(lang.encode())
        of_word = _mixed(np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], np.uint64) ^ np.uint64(salt))
        self.hash = of_word[self.word] if len(self.word) else np.zeros(0, np.uint64)

    def hashes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the phrase of k words that begins at each word, and whether it lies in one piece."""
        n = max(len(self.word) - k + 1, 0)
        h = self.hash[:n]
        for j in range(1, k):
            h = _joined(h, self.hash[j : j + n])
        return h, self.place[:n] == self.place[k - 1 : k - 1 + n]

    def counts(self, k: int, at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The different phrases of k words that begin at ``at``, and their numbers."""
        code = self.word[at]
        for j in range(1, k):  # codes of the phrase so far are few again before a word is added
            _, code = np.unique(code, return_inverse=True)
            code = code * len(self.words) + self.word[at + j]
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        columns = [[self.words[w] for w in self.word[at[first] + j].tolist()] for j in range(k)]
        return list(map(b" ".join, zip(*columns))), n


def _stretches(batches):
    """Stretches of the texts of (lang, text) batches, language by language."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            total += len(text)
            if size[lang] >= STRETCH or total >= HELD:
                big = max(size, key=size.get)
                yield Stretch(big, held.pop(big))
                total -= size.pop(big)
    for lang, texts in held.items():
        yield Stretch(lang, texts)


@dataclass(frozen=True)
class Sieve:
    """Bitmaps of the hashes of frequent phrases of k - 1 words and of full buckets of phrases of k words."""

    k: int
    bits: int
    frequent: np.ndarray
    full: np.ndarray

    def _has(self, bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = bucket(h, self.bits)
        return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def passes(self, s: Stretch) -> np.ndarray:
        """For each beginning of a phrase of k words, whether it may be frequent."""
        h, whole = s.hashes(self.k)
        part, _ = s.hashes(self.k - 1)
        known = self._has(self.frequent, part)
        return whole & known[: len(h)] & known[1 : len(h) + 1] & self._has(self.full, h)


def phrase_hash(lang: str, words: list[bytes]) -> int:
    """The hash of one phrase, as :meth:`Stretch.hashes` gives it."""
    salt = xxhash.xxh3_64_intdigest(lang.encode())
    h = _mixed(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64) ^ np.uint64(salt))
    out = h[:1]
    for j in range(1, len(h)):
        out = _joined(out, h[j : j + 1])
    return int(out[0])


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _zipped(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _blocks(at: np.ndarray, n: np.ndarray | int, least: int, bits: int):
    """(range, block) of bucket counts: buckets of a range and what each gets, ``least`` at most."""
    found, back = np.unique(at, return_inverse=True)
    total = np.minimum(np.bincount(back, np.broadcast_to(n, at.shape), len(found)), least).astype(np.uint32)
    cuts = np.searchsorted(found >> RANGE_BITS, np.arange((1 << max(bits - RANGE_BITS, 0)) + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        own = (found[cuts[k] : cuts[k + 1]] & (1 << RANGE_BITS) - 1).astype(np.uint32)
        planes = np.stack([own, total[cuts[k] : cuts[k + 1]]]).view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1)
        yield int(k), _zipped(np.ascontiguousarray(planes).tobytes())


def _unblocked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(2, 4, -1).transpose(0, 2, 1)
    own, n = np.ascontiguousarray(raw).view(np.uint32)[..., 0]
    return own, n


def _bitmap(blocks: DataFrame, least: int, bits: int) -> np.ndarray:
    """Bits of the buckets whose blocks (range, block) add up to ``least``; a byte for eight, 2 ** (bits - 3) bytes in all."""

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        for k, group in itertools.groupby(rows(), key=lambda r: r[0]):
            total = np.zeros(1 << RANGE_BITS, np.uint64)
            for _, block in group:
                own, n = _unblocked(block)
                total[own] += n
            full = np.packbits(total >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([_zipped(full)], pa.binary())], ["range", "block"])

    out = np.zeros(max(1 << bits, 1 << RANGE_BITS) >> 3, np.uint8)
    wide = 1 << RANGE_BITS >> 3
    for r in blocks.repartition("range").sortWithinPartitions("range").mapInArrow(run, "range long, block binary").toLocalIterator():
        out[r["range"] * wide : (r["range"] + 1) * wide] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["block"]), np.uint8)
    return out


def _pass(rows: DataFrame, k: int, longest: int, least: int, bits: int, sieve) -> DataFrame:
    """One pass over the texts: exact counts of phrases of k words (kind 0), tokens of a stretch (kind 1), buckets of phrases of k + 1 words (kind 2)."""

    def run(batches):
        for s in _stretches(batches):
            known = sieve.value if sieve is not None else None
            ok = np.ones(len(s.word), bool) if known is None else known.passes(s)
            phrases, n = s.counts(k, np.flatnonzero(ok))
            blocks = []
            if k < longest:
                h, whole = s.hashes(k + 1)
                blocks = list(_blocks(bucket(h[whole & ok[: len(h)] & ok[1 : len(h) + 1]], bits), 1, least, bits))
            a, b = len(phrases), len(blocks)
            columns = [
                pa.array([0] * a + [1] + [2] * b, pa.int32()), pa.array([s.lang] * (a + 1) + [None] * b, pa.string()), pa.array(phrases + [None] * (b + 1), pa.binary()).cast(pa.string()),
                pa.array([*n.tolist(), len(s.word)] + [None] * b, pa.int64()), pa.array([None] * (a + 1) + [r for r, _ in blocks], pa.int64()), pa.array([None] * (a + 1) + [x for _, x in blocks], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "lang", "phrase", "n", "range", "block"])

    return rows.mapInArrow(run, "kind int, lang string, phrase string, n long, range long, block binary")


def _phrase_blocks(counts: DataFrame, k: int, least: int, bits: int) -> DataFrame:
    """(range, block) that fill the buckets of the phrases of k words in ``counts`` (lang, phrase)."""

    def run(batches):
        for batch in batches:
            at = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                at.append(phrase_hash(lang, phrase.split(b" ")))
            found = list(_blocks(bucket(np.array(at, np.uint64), bits), least, least, bits))
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["range", "block"])

    return counts.select("lang", "phrase").mapInArrow(run, "range long, block binary")


def phrase_counts(docs: DataFrame, longest: int = 4, least: int = 30, lang_col: str = "lang", text_col: str = "text") -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, f) of the phrases of 1, 2, ... ``longest`` words that occur ``least`` times, and (lang, n) of all words."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(RANGE_BITS, int(size / (6 * LOAD) + 1).bit_length()))
    counts, totals, sieve = [], None, None
    for k in range(1, longest + 1):
        raw = written(_pass(rows, k, longest, least, bits, sieve), "phrase-pass")
        if sieve is not None:
            sieve.unpersist()
        exact = raw.where("kind = 0").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        counts.append(written(exact, "phrases"))
        if k == 1:
            totals = written(raw.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("n")), "words")
        if k < longest:
            frequent = _bitmap(_phrase_blocks(counts[-1], k, least, bits), least, bits)
            full = _bitmap(raw.where("kind = 2").select("range", "block"), least, bits)
            sieve = rows.sparkSession.sparkContext.broadcast(Sieve(k + 1, bits, frequent, full))
        spent(raw)
    return counts, totals


def _part(first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice("words", first, n), " ")


def scored(counts: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all candidates: the cut of the lowest score, floor(2,000,000 a / (l + r))."""
    longer = functools.reduce(DataFrame.union, counts[1:]).select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = longer.withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("first"), _part(F.col("cut") + 1, F.size("words")).alias("rest"))
    parts = functools.reduce(DataFrame.union, counts[:-1])
    both = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    both = both.withColumn("score", F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)"))
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def explained(counts: list[DataFrame], share: int) -> DataFrame:
    """(lang, phrase): those that lie inside a longer one with ``share`` percent of their occurrences."""
    longer = functools.reduce(DataFrame.union, counts[2:]).select("lang", F.col("f").alias("more"), F.split("phrase", " ").alias("words"))
    spans = F.expr("flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), i -> array_join(slice(words, i, n), ' '))))")
    most = longer.select("lang", "more", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    own = functools.reduce(DataFrame.union, counts[1:-1])
    return own.join(most, ["lang", "phrase"]).where(F.expr("cast(more as decimal(20, 0)) * 100 >= cast(f as decimal(20, 0)) * " + str(int(share)))).select("lang", "phrase")


def collocations(docs: DataFrame, top: int = 2000, longest: int = 4, least: int = 30, share: int = 80, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a (occurrences), l and r (those of the two parts), n (words of the language), score."""
    counts, totals = phrase_counts(docs, longest, least, lang_col, text_col)
    kept = written(scored(counts).join(explained(counts, share), ["lang", "phrase"], "left_anti"), "collocations")
    # the best of parts of a language first, so that no task ranks all phrases of one
    parts = 1 + kept.count() // PER_TASK
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
