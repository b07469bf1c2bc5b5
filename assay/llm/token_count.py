"""Token counts by merging arrays of pre-tokens, all sequences at once.

A task cuts its texts into pre-tokens, keeps the different ones as one ragged array of symbols, and merges in rounds: each
sequence finds its lowest-ranked pair and applies it, all sequences in the same step.  A pair that occurs several
times is applied everywhere in a sequence at once, from the left, unless a merge may bring forth a pair of the same or a better rank; such a
step applies the leftmost pair alone, as one-by-one merging would.  Sequences without a pair leave the array.  The symbols that are
left are counted, a character outside the vocabulary as the tokens of its bytes.

Pre-tokens are cut between characters that stand side by side in no token, so no merge can cross a cut.  Two kinds of vocabulary are read:
SentencePiece BPE models with byte fallback (``.model``) and byte-level rank files (``.tiktoken``, cut by a pattern).

Defined results: null counts as the empty text, with no bytes and no tokens; null ids and repeated rows stay as they are; equal texts have equal counts; ties between
pairs of one rank go to the left; texts of any length count whole; strings of special tokens are ordinary text; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

BLANK = "▁"
#: Bytes of text whose pre-tokens are held together.
STRETCH = 8 << 20
#: Symbols of a sequence from which steps of one pair go through a queue of its own.
LONG = 256
NEVER = np.iinfo(np.int32).max


class Merges:
    """Pairs of symbols with the rank of their merge and its result.

    ``ranks`` maps every token (a string or bytes) to its rank; tokens of one unit, and units that only stand inside tokens, are
    symbols as well.  Two symbols merge if they make up a token.
    """

    def __init__(self, ranks: dict):
        units = sorted({t[i : i + 1] for t in ranks for i in range(len(t))})
        self.symbol = {u: i for i, u in enumerate(units)}
        for token in ranks:
            self.symbol.setdefault(token, len(self.symbol))
        self.units = units
        #: One number more stands for any unit that is in no token.
        self.n = len(self.symbol) + 1
        rank = np.full(self.n, NEVER, np.int32)
        for token, r in ranks.items():
            rank[self.symbol[token]] = r
        pairs = [(self.symbol[t[:k]] * self.n + self.symbol[t[k:]], self.symbol[t]) for t in ranks for k in range(1, len(t)) if t[:k] in self.symbol and t[k:] in self.symbol]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.results = np.array([r for _, r in pairs], np.int32)
        self.ranks = rank[self.results] if pairs else np.zeros(0, np.int32)
        #: Symbols that are part of a merge of the same or a better rank: what follows their own merge may come before it elsewhere.
        self.hasty = np.zeros(self.n, bool)
        for side in (self.keys // self.n, self.keys % self.n):
            self.hasty[side[self.ranks <= rank[side]]] = True
        self.hasty[rank == NEVER] = False

    def of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs; NEVER where two symbols do not merge."""
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if len(self.keys) else np.zeros(len(key), np.int64)
        ok = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        return np.where(ok, self.ranks[at], NEVER).astype(np.int32) if len(self.keys) else np.full(len(key), NEVER, np.int32), np.where(ok, self.results[at], -1) if len(self.keys) else np.full(len(key), -1)

    def survivors(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left of the sequences that begin at ``starts``, and the number of the sequence of each."""
        done_symbols, done_owners = [], []
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(symbols))))
        symbols, owner = symbols.astype(np.int32), owner.astype(np.int64)
        rank, result = self._pairs(symbols, owner)
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(symbols)))
            open_ = lowest < NEVER
            if open_.sum() < 0.7 * len(open_):  # finished sequences leave
                stay = np.repeat(open_, sizes)
                done_symbols.append(symbols[~stay])
                done_owners.append(owner[~stay])
                symbols, owner, rank, result = symbols[stay], owner[stay], rank[stay], result[stay]
                continue
            here = np.flatnonzero((rank == np.repeat(lowest, sizes)) & (rank < NEVER))
            sequence = np.searchsorted(first, here, "right") - 1
            single = np.zeros(len(first), bool)
            single[sequence[self.hasty[result[here]]]] = True
            queued = single & (sizes >= LONG)
            if queued.any():
                gone = np.repeat(queued, sizes)
                for k in np.flatnonzero(queued):
                    left = self._one_by_one(symbols[first[k] : first[k] + sizes[k]])
                    done_symbols.append(left)
                    done_owners.append(np.full(len(left), owner[first[k]]))
                symbols, owner, rank, result = symbols[~gone], owner[~gone], rank[~gone], result[~gone]
                continue
            leftmost = np.concatenate([[True], sequence[1:] != sequence[:-1]])
            here, sequence = here[leftmost | ~single[sequence]], sequence[leftmost | ~single[sequence]]
            # of pairs that overlap, every other one from the left
            run = np.concatenate([[True], (here[1:] != here[:-1] + 1)])
            place = np.arange(len(here)) - np.maximum.accumulate(np.where(run, np.arange(len(here)), 0))
            here = here[place % 2 == 0]
            symbols[here] = result[here]
            keep = np.ones(len(symbols), bool)
            keep[here + 1] = False
            touched = np.zeros(len(symbols), bool)
            touched[here] = True
            symbols, owner, rank, result, touched = symbols[keep], owner[keep], rank[keep], result[keep], touched[keep]
            touched[:-1] |= touched[1:]
            again = np.flatnonzero(touched)
            rank[again], result[again] = self._pairs(symbols, owner, again)
        return np.concatenate([np.zeros(0, np.int32), *done_symbols]), np.concatenate([np.zeros(0, np.int64), *done_owners])

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs that begin at ``at`` (everywhere if None); the last of a sequence begins none."""
        at = np.arange(len(symbols)) if at is None else at
        after = np.minimum(at + 1, len(symbols) - 1)
        rank, result = self.of(symbols[at], symbols[after])
        inside = (after > at) & (owner[at] == owner[after])
        return np.where(inside, rank, NEVER).astype(np.int32), np.where(inside, result, -1).astype(np.int32)

    @functools.cached_property
    def _table(self) -> dict[int, tuple[int, int]]:
        return {int(k): (int(r), int(s)) for k, r, s in zip(self.keys, self.ranks, self.results)}

    def _one_by_one(self, symbols: np.ndarray) -> np.ndarray:
        """A single long sequence, always its best pair, from the left, through a queue."""
        symbol, n, table = symbols.tolist(), self.n, self._table
        after, before = [*range(1, len(symbol)), -1], [-1, *range(len(symbol) - 1)]
        queue = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                pair = symbol[i] * n + symbol[after[i]]
                if pair in table:
                    heapq.heappush(queue, (table[pair][0], i, pair))

        for i in range(len(symbol)):
            offer(i)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i] if symbol[i] >= 0 else -1
            if j < 0 or symbol[i] * n + symbol[j] != pair:
                continue  # one of the two has changed meanwhile
            symbol[i], symbol[j] = table[pair][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return np.array([s for s in symbol if s >= 0], np.int32)


class PieceCounter:
    """Counts tokens as a SentencePiece BPE model with byte fallback gives them."""

    def __init__(self, model_file: str, most: int = 1_000_000):
        #: Counts of chunks (blanks and the word after them) met before, up to ``most``.
        self.seen, self.most = {}, most
        proto, kinds = model_pb2.ModelProto(), model_pb2.ModelProto.SentencePiece
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if (
            proto.trainer_spec.model_type != model_pb2.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces
            or not spec.add_dummy_prefix or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix
            or any(p.type not in (kinds.NORMAL, kinds.CONTROL, kinds.BYTE, kinds.UNKNOWN) for p in proto.pieces)
        ):
            raise ValueError("only BPE models with byte fallback, identity normalisation and a blank put first are counted")
        normal = [p for p in proto.pieces if p.type == kinds.NORMAL]
        places = {score: i for i, score in enumerate(sorted({p.score for p in normal}, reverse=True))}
        self.merges = Merges({p.piece.replace(BLANK, " "): places[p.score] for p in normal})
        other = self.merges.n - 1
        self.of_char = np.full(0x110000, other, np.int32)
        for u in self.merges.units:
            self.of_char[ord(u)] = self.merges.symbol[u]
        #: Which units stand side by side in a token.
        self.beside = np.zeros((len(self.merges.units) + 1, len(self.merges.units) + 1), bool)
        for token in self.merges.symbol:
            for a, b in zip(token, token[1:]):
                self.beside[self.merges.symbol[a], self.merges.symbol[b]] = True
        #: Tokens of a symbol: one for a piece, those of its bytes for a character that is none.
        self.weight = np.ones(self.merges.n, np.int64)
        pieces = {p.piece.replace(BLANK, " ") for p in normal}
        for u in self.merges.units:
            if u not in pieces:
                self.weight[self.merges.symbol[u]] = len(u.encode())

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text (UTF-8)."""
        lines = [b" " + t.replace(BLANK.encode(), b" ") if t else b"" for t in texts]
        data = np.frombuffer(b"".join(lines), np.uint8)
        if not len(data):
            return np.zeros(len(texts), np.int64)
        blank = data == 32
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        begins = np.cumsum([0, *map(len, lines)])
        cut[begins[:-1][np.diff(begins) > 0]] = True
        at = np.flatnonzero(cut)
        offsets = pa.py_buffer(np.append(at, len(data)).astype(np.int64))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(at), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        words = chunks.dictionary.to_pylist()
        if len(self.seen) + len(words) > self.most:
            self.seen.clear()
        new = [w for w in words if w not in self.seen]
        self.seen.update(zip(new, self._of_chunks(new).tolist()))
        each = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))[chunks.indices.to_numpy()]
        return np.diff(np.append(0, np.cumsum(each))[np.searchsorted(at, begins)])

    def _of_chunks(self, chunks: list[bytes]) -> np.ndarray:
        """Tokens of each of some different chunks."""
        if not chunks:
            return np.zeros(0, np.int64)
        texts = [c.decode() for c in chunks]
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        chunk = np.repeat(np.arange(len(texts)), sizes)
        symbols = self.of_char[chars]
        other, known = self.merges.n - 1, np.minimum(symbols, len(self.merges.units))
        cut = np.ones(len(chars), bool)
        cut[1:] = (chunk[1:] != chunk[:-1]) | ~self.beside[known[:-1], known[1:]]
        starts = np.flatnonzero(cut)
        left, sequence = self.merges.survivors(symbols, starts)
        weight = self.weight[left]
        total = np.bincount(chunk[starts[sequence]], np.where(left == other, 0, weight), len(texts)).astype(np.int64)
        # characters in no token count with their bytes
        strange = symbols == other
        width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        return total + np.bincount(chunk[strange], width[strange], len(texts)).astype(np.int64)


class ByteCounter:
    """Counts tokens as a byte-level vocabulary of ranks gives them, cut by ``pattern``."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merges, self.pattern = Merges(ranks), regex.compile(pattern)
        self.of_byte = np.array([self.merges.symbol[bytes([b])] for b in range(256)], np.int32)

    def counts(self, texts: list[bytes]) -> np.ndarray:
        found = [[w.encode() for w in self.pattern.findall(t.decode())] for t in texts]
        chunks = pa.array([w for f in found for w in f], pa.binary()).dictionary_encode()
        words = chunks.dictionary.to_pylist()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        _, sequence = self.merges.survivors(symbols, np.cumsum(sizes) - sizes)
        each = np.bincount(sequence, minlength=len(words))[chunks.indices.to_numpy()] if words else np.zeros(0, np.int64)
        return np.diff(np.append(0, np.cumsum(each))[np.cumsum([0, *map(len, found)])])


@functools.lru_cache(2)
def _counter(file: str, pattern: str | None) -> PieceCounter | ByteCounter:
    if file.endswith(".model"):
        return PieceCounter(file)
    if file.endswith(".tiktoken") and pattern:
        return ByteCounter(file, pattern)
    raise ValueError("a .model file, or a .tiktoken file with its pattern, is needed")


def token_counts(docs: DataFrame, file: str, limit: int = 4096, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every row; ``file`` is the vocabulary, ``pattern`` cuts for rank files."""

    def run(batches):
        counter = _counter(file, pattern)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            ends = np.cumsum([0, *map(len, texts)])
            at, counts = 0, [np.zeros(0, np.int64)]
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + STRETCH)))
                counts.append(counter.counts(texts[at:to]))
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(np.concatenate(counts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
