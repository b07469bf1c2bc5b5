"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are compared as bytes, ASCII letters in lower case and white
space as blanks.  An occurrence of an item of m bytes with at most e edits keeps at
least m - q + 1 - q * e of its q-grams, on diagonals (text offset less item offset) that
are at most e apart.  Shared q-grams are counted in bands of 2 * (e + 1) diagonals, each
overlapping the next by half; a band that reaches the bound is verified by an
alignment inside it, which gives the span and its edits.

The index of q-grams of a bounded part of the benchmark is broadcast; a larger
benchmark is read in several parts, each compared with all documents.
Items too short for the bound at q = 12 (20 to 23 bytes with one edit) have shorter grams.  Items too short for a gram are searched as they are: whole (no edits are allowed at that length) and as words of their own.
A row is known by its id and the hash of its text (``content``), so rows that share an id, or have none, keep their own spans.
Defined results: null and blank texts and items match nothing; repeated rows and items count once; of overlapping occurrences of an
item the one with the fewest edits stays, of equal ones the first; spans count code points of the
original text; very long texts count whole; an empty table or benchmark gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import written

Q = 12
#: Edits allowed, as a share of an item's bytes.
EDIT_SHARE = 0.05
#: Bytes of benchmark text in one index (an index takes some 20 times that), and bytes of text handled at once.
PART_BYTES, BLOCK_BYTES = 4 << 20, 2 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def folded(text: bytes) -> np.ndarray:
    return _FOLD[np.frombuffer(text, np.uint8)]


def q_grams(text: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hashes of all grams of ``q`` bytes, 8 to 12."""
    if len(text) < q:
        return np.empty(0, np.uint64)
    two = text[:-1].astype(np.uint32) | text[1:].astype(np.uint32) << np.uint32(8)
    four = two[:-2] | two[2:] << np.uint32(16)
    eight = four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32)
    n = len(text) - q + 1
    x = (eight[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ (four[q - 4 : q - 4 + n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))
    return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """q-grams of benchmark items, sorted by hash, with the items and offsets where they stand.

    Items whose bound would not be positive have grams of fewer bytes, in an index of their own (``finer``).
    """

    def __init__(self, items: list[tuple[int, str]], edit_share: float = EDIT_SHARE, q: int = Q):
        self.q = q
        every = [(i, folded(t.strip().encode("utf-8", "surrogateescape"))) for i, t in items if t is not None and i is not None and t.strip()]
        kept = [(i, t) for i, t in every if len(t) >= Q]
        #: items without a gram: one expression finds them as whole words
        short = sorted({t.tobytes() for _, t in every if len(t) < Q}, key=lambda t: (-len(t), t))
        self.short_ids = {t: sorted(i for i, u in every if u.tobytes() == t) for t in short}
        self.short = [re.compile(rb"(?<![0-9A-Za-z_\x80-\xff])" + re.escape(t) + rb"(?![0-9A-Za-z_\x80-\xff])") for t in short]
        allowed = {len(t): int(len(t) * edit_share) for _, t in kept}
        fine = [m for m, e in allowed.items() if m - q + 1 - q * e < 1]
        less = min((m // (allowed[m] + 1) for m in fine), default=q)
        self.finer = None
        if 8 <= less < q:
            self.finer = Index([(i, t.tobytes().decode("utf-8", "surrogateescape")) for i, t in kept if len(t) in fine], edit_share, less)
            kept = [(i, t) for i, t in kept if len(t) not in fine]
        self.ids = [i for i, _ in kept]
        self.texts = [t for _, t in kept]
        sizes = np.array([len(t) for t in self.texts], np.int64)
        # the bound must stay positive
        self.edits = np.minimum((sizes * edit_share).astype(np.int64), np.maximum((sizes - q) // q, 0))
        self.least = sizes - q + 1 - q * self.edits
        grams = [q_grams(t, q) for t in self.texts]
        codes = np.concatenate([np.empty(0, np.uint64), *grams])
        order = np.argsort(codes, kind="stable")
        self.codes, starts = np.unique(codes[order], return_index=True)
        self.starts = np.append(starts, len(codes))
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.offset = np.concatenate([np.empty(0, np.int64), *(np.arange(len(g)) for g in grams)])[order].astype(np.int64)
        self.bits = max(16, min(26, int(len(self.codes) * 64).bit_length()))
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[self.codes >> np.uint64(64 - self.bits)] = True
        self.longest = max(int((sizes + 2 * self.edits).max()) + q if len(kept) else Q, self.finer.longest if self.finer else Q)

    def candidates(self, text: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal of a band) of the bands of ``text`` that reach their item's bound."""
        codes = q_grams(text, self.q)
        at = np.flatnonzero(self.filter[codes >> np.uint64(64 - self.bits)])
        if not len(at) or not len(self.codes):
            return []
        where = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        right = self.codes[where] == codes[at]
        at, where = at[right], where[right]
        n = self.starts[where + 1] - self.starts[where]
        posting = np.repeat(self.starts[where] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item = self.item[posting]
        step = self.edits[item] + 1
        shift = self.longest * 2  # diagonals may be negative
        band = (np.repeat(at, n) - self.offset[posting] + shift) // step
        wide = len(text) + 2 * shift + 2
        keys, counts = np.unique(np.concatenate([item * wide + band, item * wide + band - 1]), return_counts=True)
        item, band = keys // wide, keys % wide
        good = counts >= self.least[item]
        return [(int(i), int(b * (self.edits[i] + 1) - shift)) for i, b in zip(item[good], band[good])]

    def spans(self, text: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item id, begin, end, edits) of the verified occurrences in a folded text; the best of those that overlap."""
        best: dict[int, list[tuple[int, int, int]]] = {}
        for item, low in self.candidates(text):
            e = int(self.edits[item])
            found = aligned(self.texts[item], text, low, 2 * (e + 1), e)
            if found:
                best.setdefault(item, []).append(found)
        out = []
        for item, spans in best.items():
            taken: list[tuple[int, int]] = []
            for edits, begin, end in sorted(spans):
                if all(end <= b or begin >= e for b, e in taken):
                    out.append((self.ids[item], begin, end, edits))
                    taken.append((begin, end))
        raw = text.tobytes() if self.short else b""
        for pattern in self.short:
            for m in pattern.finditer(raw):
                out += [(i, m.start(), m.end(), 0) for i in self.short_ids[m.group()]]
        return out + (self.finer.spans(text) if self.finer else [])


def aligned(item: np.ndarray, text: np.ndarray, low: int, width: int, most: int) -> tuple[int, int, int] | None:
    """(edits, begin, end) of the best alignment of the whole item with a part of ``text`` on the
    diagonals low .. low + width - 1, if it takes at most ``most`` edits.

    Row i of the band holds, for each diagonal, the least cost of aligning the first i bytes and where that alignment began.
    """
    m, unit = len(item), 1 << 32
    pad = np.full(m + width, 256, np.int16)
    lo, hi = max(low, 0), min(low + m + width, len(text))
    if hi > lo:
        pad[lo - low : hi - low] = text[lo:hi]
    whole = np.flatnonzero([bool((pad[d : d + m] == item).all()) for d in range(width)])
    if len(whole):
        return 0, low + int(whole[0]), low + int(whole[0]) + m
    steps = np.arange(width, dtype=np.int64) * unit
    row = np.arange(width, dtype=np.int64)  # cost 0, begun on diagonal d
    for i in range(m):
        now = row + (pad[i : i + width] != item[i]) * unit
        now[:-1] = np.minimum(now[:-1], row[1:] + unit)
        row = np.minimum.accumulate(now - steps) + steps
    d = int(np.argmin(row))
    cost, first = divmod(int(row[d]), unit)
    if cost > most:
        return None
    begin, end = max(low + first, 0), min(low + d + m, len(text))
    return cost, begin, max(begin, end)


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", edit_share: float = EDIT_SHARE, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """A row for each occurrence of a benchmark item: doc_id, content, item_id, begin, end, edits."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    parts = -(-int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // part_bytes) or 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("content"), F.col(text_col).alias("text"))
    found = []
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        index = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in part.collect()], edit_share))
        one = rows.mapInArrow(_search(index), "doc_id long, content long, item_id long, begin int, end int, edits int")
        found.append(one if parts == 1 else written(one, "leaks"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def _search(index):
    """Batches of (doc_id, content, text) to batches of occurrences."""

    def run(batches):
        found = index.value
        for batch in batches:
            out = []
            rows, texts = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), batch.column(2).cast(pa.binary()).to_pylist()
            for which, at, block in blocks(texts, found.longest):
                starts = np.array(at)
                for item, begin, end, edits in found.spans(block):
                    # an alignment may begin in the gap before its document and end in the gap behind it
                    k = int(np.searchsorted(starts, end - 1, "right")) - 1
                    doc, base = which[k]
                    # what begins before a later part of a text is found whole in the part before
                    if begin >= at[k] or not base:
                        begin, end = max(begin - at[k], 0) + base, end - at[k] + base
                        out.append((*rows[doc], item, _chars(texts[doc], begin), _chars(texts[doc], min(end, len(texts[doc]))), edits))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], ["doc_id", "content", "item_id", "begin", "end", "edits"])

    return run


def blocks(texts: list[bytes | None], overlap: int):
    """Folded texts put together, ``overlap`` zero bytes between them, in blocks; very long texts are cut into overlapping parts.

    Yields ([(text number, offset in the text)], [offset in the block], block).
    """
    gap = np.zeros(overlap, np.uint8)
    which, at, parts, size = [], [], [], 0
    for k, text in enumerate(texts):
        for base in range(0, max(len(text or b""), 1), BLOCK_BYTES):
            part = folded((text or b"")[base : base + BLOCK_BYTES + overlap])
            if not len(part):
                continue
            which.append((k, base))
            at.append(size)
            parts += [part, gap]
            size += len(part) + overlap
            if size >= BLOCK_BYTES:
                yield which, at, np.concatenate(parts)
                which, at, parts, size = [], [], [], 0
    if parts:
        yield which, at, np.concatenate(parts)


def _chars(text: bytes, offset: int) -> int:
    """Code points that begin before a byte offset."""
    head = np.frombuffer(text[:offset], np.uint8)
    return int(((head & 0xC0) != 0x80).sum())
