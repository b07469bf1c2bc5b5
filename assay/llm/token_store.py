"""Token ids in binary shards compressed by a Re-Pair grammar.

Documents are dealt by ranges of ``doc_id``; every task encodes its documents in order
and closes a shard whenever it holds ``shard_tokens`` ids.  In each shard frequent
pairs of ids are replaced by nonterminals, again and again; the shard stores the
rules, the length each rule expands to, and the remaining sequence, so any range of ids
can be decoded without expanding the rest.

A shard is one binary value (see :func:`pack`); shards are rows of a Parquet table, which
every file system that Spark writes can hold.  Ids of a text come from the tokenizers
library; a worker remembers the ids of words it has met, as this tokenizer never
joins characters across white space.

Defined results: a null text counts as empty (just the end id); null ids of documents come
first; rows of one id come in the order of the hashes of their texts, and repeated rows repeat; a very long text is a document as any other, and
makes its shard longer; an empty table gives no shards; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from assay.llm.common import shared_dir

SHARD_TOKENS = 1 << 19
MAGIC = b"RPG1"
#: Byte-level tokenizers write a byte as the letter of its number, and bytes without a visible letter as letters from 256 on (no word has a blank).
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173]) if b != 32}
_ODD_BYTES = re.compile("[\x7f-\xa0\xad]")


class WordEncoder:
    """ids of texts by a tokenizers file whose normaliser and pre-tokeniser work within words."""

    def __init__(self, path: str, most: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [p["type"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        #: lower case in between, white space dropped, byte-level letters: ASCII words may go to the BPE model as they are
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and splits == ["Split", "ByteLevel"]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        #: the BPE model alone, for words of letters with blanks between them; the last token of a word is one of `last`
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self.by_word = self.by_word and bool(suffix)
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids[0] for m in ",."} if self.by_word else {}
        self.most = most
        self._forget()

    def _forget(self) -> None:
        """No word is known but the empty one.  Word number k has ``size[k]`` ids from ``begin[k]`` on in ``flat``."""
        self.seen = {"": 0}
        self.flat, self.begin, self.size = np.zeros(0, self.kind), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def encode_batch(self, texts: list[bytes]) -> list[np.ndarray]:
        """ids of each text, in stretches of some megabytes."""
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > 8 << 20:
                out += self._stretch(held)
                held, size = [], 0
        return out + self._stretch(held)

    def _stretch(self, texts: list[bytes]) -> list[np.ndarray]:
        low = [t.lower() for t in texts]
        whole = [not self.by_word or any(s in t for s in self.special) for t in low]
        words = pc.ascii_split_whitespace(pa.array([b"" if w else t for w, t in zip(whole, low)], pa.binary()).cast(pa.string()))
        coded = words.flatten().dictionary_encode()
        number = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        n = self.size[number]
        ends = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        ids = self.flat[np.repeat(self.begin[number] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return [
            np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.kind) if w else ids[bounds[k] : bounds[k + 1]]
            for k, (w, text) in enumerate(zip(whole, texts))
        ]

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of words.  New words of Latin letters, with a comma or stop behind them or not, go to the BPE model as they are: a
        mark after a letter is always a token of its own.  All others are encoded by the library as texts."""
        if len(self.seen) > self.most:
            self._forget()
        new = pa.array([w for w in words if w not in self.seen], pa.string())
        marked = pc.match_substring_regex(new, "[,.]$")
        stems = pc.if_else(marked, pc.utf8_slice_codeunits(new, 0, -1), new)
        plain = pc.and_(pc.utf8_is_alpha(stems), pc.match_substring_regex(stems, "^[A-Za-z\u00aa-\u012f\u0131-\u024f]+$"))
        own = stems.filter(plain).dictionary_encode()
        names, rest = new.filter(plain).to_pylist(), new.filter(pc.invert(plain)).to_pylist()
        flat, size = self._coded(own.dictionary)
        # the ids of a word are those of its stem and then its mark
        stem = own.indices.to_numpy()
        mark = np.array([self.marks.get(w[-1], -1) for w in names], np.int64)
        n = size[stem] + (mark >= 0)
        ends = np.cumsum(n)
        ids = flat[np.minimum(np.repeat((np.cumsum(size) - size)[stem] - ends + n, n) + np.arange(n.sum()), max(len(flat) - 1, 0))] if len(flat) else flat
        ids[ends[mark >= 0] - 1] = mark[mark >= 0]
        other, sizes = self._encoded(rest)
        n = np.concatenate([n, sizes])
        self.seen.update(zip(names + rest, range(len(self.begin), len(self.begin) + len(new))))
        self.begin, self.size = np.concatenate([self.begin, np.cumsum(n) - n + len(self.flat)]), np.concatenate([self.size, n])
        self.flat = np.concatenate([self.flat, ids, other])
        return np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))

    def _coded(self, stems: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words of Latin letters."""
        if not len(stems):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        text = " ".join(stems.to_pylist())
        if not text.isascii():  # normalised, lower case, a letter for each byte
            text = unicodedata.normalize("NFC", text).lower().encode().decode("latin-1")
            text = _ODD_BYTES.sub(lambda m: chr(_BYTE_LETTERS[ord(m.group())]), text)
        parts = self.letters.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(parts[0].ids, self.kind)
        ends = np.flatnonzero(self.last[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(stems) else self._encoded(stems.to_pylist())

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words, from the library."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], self.kind), np.array([len(ids) for ids in found], np.int64)


@functools.lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def grammar(ids: np.ndarray, first: int, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(rules, sequence): Re-Pair on ``ids``; nonterminals are numbered from ``first`` on.

    A round replaces the pairs that occur ``need`` times and more, where they meet the more frequent one first; ``need``
    falls by half or more from round to round, and at ``least`` rounds go on until no pair occurs so often.  There a
    place that had a rarer pair is not looked at again before a neighbour changes.
    """
    seq, rules, made = ids.astype(np.uint64), [], 0
    steps = [n for n in (2048, 512, 128, 48, 16, 6) if least < n < len(seq) // 16]
    open_ = None
    while len(seq) > 1:
        need = steps.pop(0) if steps else least
        at, pairs, code, counts = _frequent(seq, np.flatnonzero(open_[:-1]) if open_ is not None else np.arange(len(seq) - 1), need)
        if not steps and need == least:
            open_ = np.zeros(len(seq), bool)
            open_[at] = True
        if len(at):
            keep = _best_of_neighbours(at, code, counts, pairs)
            at, pairs, code = at[keep], pairs[keep], code[keep]
            # a rule must still pay where its places were not taken by others
            ok = np.bincount(code, minlength=len(counts)) >= max(2, least)
            keep = ok[code]
            at, pairs, code = at[keep], pairs[keep], (np.cumsum(ok) - 1)[code[keep]]
        if len(at):
            chosen = np.empty(int(ok.sum()), np.uint64)
            chosen[code] = pairs
            seq[at] = (first + made + code).astype(np.uint64)
            stay = np.ones(len(seq), bool)
            stay[at + 1] = False
            seq = seq[stay]
            if open_ is not None:
                open_[at] = True
                open_[np.maximum(at - 1, 0)] = True
                # a symbol before may have been joined with the one before it
                open_[np.maximum(at - 2, 0)] |= ~stay[np.maximum(at - 1, 0)]
                open_ = open_[stay]
            rules.append(chosen)
            made += len(chosen)
        elif need == least:
            break
    flat = np.concatenate([np.empty(0, np.uint64), *rules])
    return np.stack([flat >> np.uint64(32), flat & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32), seq.astype(np.uint32)


def _frequent(seq: np.ndarray, where: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, pairs there, their numbers, counts by number) of the pairs that occur ``need`` times or more at the places ``where``."""
    pairs = seq[where] << np.uint64(32) | seq[where + 1]
    # counts of hashes in a table leave few pairs to count exactly
    bits = 17 if need >= 16 else max(8, min(19, (2 * len(where)).bit_length()))
    slot = ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    keep = np.flatnonzero((np.bincount(slot, minlength=1 << bits) >= need)[slot])
    where, pairs = where[keep], pairs[keep]
    _, back, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    ok = counts >= need
    keep = ok[back]
    return where[keep], pairs[keep], (np.cumsum(ok) - 1)[back[keep]], counts[ok]


def _best_of_neighbours(at: np.ndarray, code: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Which places to replace: never two that overlap; of overlapping ones the more frequent, of equals by a hash of the
    pair (so copies of a passage are cut alike), and of a run of one pair every second."""
    tie = (pairs * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)
    rank = counts[code].astype(np.int64) << 32 | tie.astype(np.int64)
    close = np.diff(at) == 1
    same = close & (code[1:] == code[:-1])
    begins = np.flatnonzero(np.concatenate([[True], ~same]))
    even = (np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))) % 2 == 0
    ok = even.copy()
    lower = close & ~same
    ok[1:] &= ~(lower & (rank[:-1] >= rank[1:]))
    ok[:-1] &= ~(lower & (rank[1:] > rank[:-1]))
    return ok


def packed(values: np.ndarray, width: int) -> bytes:
    """``values`` in ``width`` bits each, one after the other, the lowest bit first."""
    parts = []
    for k in range(0, len(values), 1 << 16):
        bits = np.unpackbits(values[k : k + (1 << 16)].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        parts.append(np.packbits(bits, bitorder="little").tobytes())
    return b"".join(parts)


def unpacked(blob: bytes, at: int, n: int, width: int) -> np.ndarray:
    """The ``n`` values of ``width`` bits that begin at byte ``at``."""
    where = np.arange(n, dtype=np.int64) * width
    raw = np.frombuffer(blob, np.uint8, -(-n * width // 8), at)
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))[where >> 3].copy().view("<u8").reshape(-1)
    return (words >> (where & 7).astype(np.uint64) & np.uint64((1 << width) - 1)).astype(np.uint32)


def pack(doc_ids: list[int | None], ids: list[np.ndarray], first: int) -> bytes:
    """A shard: header, document ids and sizes, rules, expansion lengths and the sequence, little-endian.

    Header: magic, documents, rules, sequence length, first nonterminal, bits of a symbol, bits of a length.  Symbols of rules
    and sequence take as many bits as the largest one needs.
    """
    rules, seq = grammar(np.concatenate(ids), first)
    width = max(int(first + len(rules) - 1).bit_length(), 1)
    known = [1] * first
    for a, b in rules.tolist():
        known.append(known[a] + known[b])
    lengths = np.array(known, np.int64)
    long = int(lengths.max()).bit_length()
    return b"".join([
        struct.pack("<4s4I2B", MAGIC, len(doc_ids), len(rules), len(seq), first, width, long),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([len(x) for x in ids], "<u4").tobytes(), packed(rules.reshape(-1), width), packed(lengths[first:], long), packed(seq, width),
    ])


class Shard:
    """Random access to a packed shard."""

    def __init__(self, blob: bytes):
        magic, n_docs, n_rules, n_seq, self.first, width, long = struct.unpack_from("<4s4I2B", blob)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = struct.calcsize("<4s4I2B")
        missing = np.frombuffer(blob, np.uint8, n_docs, at)
        doc_ids = np.frombuffer(blob, "<i8", n_docs, at + n_docs)
        self.doc_ids = [None if m else d for m, d in zip(missing.tolist(), doc_ids.tolist())]
        self.sizes = np.frombuffer(blob, "<u4", n_docs, at + 9 * n_docs).astype(np.int64)
        at += 13 * n_docs
        self.rules = unpacked(blob, at, 2 * n_rules, width).reshape(-1, 2)
        at += -(-2 * n_rules * width // 8)
        self.lengths = np.concatenate([np.ones(self.first, np.int64), unpacked(blob, at, n_rules, long).astype(np.int64)])
        at += -(-n_rules * long // 8)
        self.seq = unpacked(blob, at, n_seq, width)
        self.ends = np.cumsum(self.lengths[self.seq])

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids at start .. stop - 1, expanding only the symbols that cover them."""
        stop = int(self.sizes.sum()) if stop is None else stop
        if start >= stop:
            return np.empty(0, np.uint32)
        if stop - start == self.sizes.sum():
            return self._all()
        i, j = np.searchsorted(self.ends, [start, stop - 1], "right")
        seq = self._expanded(self.seq[i : j + 1])
        skip = start - int(self.ends[i] - self.lengths[self.seq[i]])
        return seq[skip : skip + stop - start]

    def _all(self) -> np.ndarray:
        """All ids: every rule is expanded once, the sequence picks from these."""
        table = np.concatenate([np.arange(self.first, dtype=np.uint32), self._expanded(np.arange(self.first, self.first + len(self.rules), dtype=np.uint32))])
        begins, n = np.cumsum(self.lengths) - self.lengths, self.lengths[self.seq]
        return table[np.repeat(begins[self.seq] - (self.ends - n), n) + np.arange(self.ends[-1])]

    def _expanded(self, seq: np.ndarray) -> np.ndarray:
        """The ids of a sequence of symbols, level by level."""
        while len(seq) and (big := seq >= self.first).any():
            n = np.where(big, 2, 1)
            out = np.repeat(seq, n)
            at = (np.cumsum(n) - n)[big]
            pair = self.rules[seq[big] - self.first]
            out[at], out[at + 1] = pair[:, 0], pair[:, 1]
            seq = out
        return seq

    def documents(self):
        """(doc_id, ids) in order."""
        flat, at = self.ids(), 0
        for doc_id, n in zip(self.doc_ids, self.sizes.tolist()):
            yield doc_id, flat[at : at + n]
            at += n


def write_shards(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes rows (part, shard, start_in_part, n_tokens, blob) to ``path``; parts and shards are in order of the document ids."""

    def run(batches):
        coder, part = encoder(tokenizer_file), TaskContext.get().partitionId()
        first = max(coder.tokenizer.get_vocab_size(), end_id + 1)
        doc_ids, ids, size, start, shard = [], [], 0, 0, 0

        def closed():
            row = [[part], [shard], [start], [size], [pack(doc_ids, ids, first)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["part", "shard", "start_in_part", "n_tokens", "blob"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for at in range(0, len(names), 2000):
                texts = batch.column(1)[at : at + 2000].cast(pa.binary()).to_pylist()
                for doc_id, found in zip(names[at : at + 2000], coder.encode_batch([t or b"" for t in texts])):
                    doc_ids.append(doc_id)
                    ids.append(np.append(found, np.array([end_id], found.dtype)))
                    size += len(ids[-1])
                    if size >= shard_tokens:
                        yield closed()
                        doc_ids, ids, start, size, shard = [], [], start + size, 0, shard + 1
        if doc_ids:
            yield closed()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # rows that share an id, or have none, are dealt out by their texts
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    rows.mapInArrow(run, "part int, shard int, start_in_part long, n_tokens long, blob binary").write.parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """Shards with ``start``, the ids in all shards before: (part, shard, start, n_tokens, blob)."""
    shards = spark.read.parquet(path)
    # a row for each part, not for each shard or document
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return shards.join(before, "part").select("part", "shard", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "blob")


def document_digests(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from :func:`read_shards`."""

    def run(batches):
        for batch in batches:
            for start, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for doc_id, ids in Shard(blob).documents():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("start", "blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored_digests(docs: DataFrame, tokenizer_file: str, end_id: int = 2) -> DataFrame:
    """Writes ``docs`` as shards to the shared folder and describes every document from the files read back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer_file, end_id)
    return document_digests(read_shards(spark, path))
