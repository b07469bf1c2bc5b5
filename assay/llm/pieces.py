"""SentencePiece encoding that keeps offsets into the original text, and decoding.

Normalisation goes through the model's compiled character map by longest prefix,
recording for every normalised byte the source byte it came from; pieces are
then projected to byte spans of the original text.

Encoding works on *chunks* (blanks and the word after them): no piece has a blank
after another character, so merges never cross the start of a chunk and the
ids of a text are those of its chunks in order.  A worker remembers the chunks it has
seen; ids of new chunks come from the sentencepiece library.  Models for which this
does not hold, or that normalise in another way, are encoded text by text.

Defined results: null counts as the empty text, which has no pieces; null ids and repeated rows
stay as they are; equal texts have equal pieces; texts of any length are encoded whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

BLANK = "▁"
_CHUNK = re.compile(rb" +[^ ]*")


class CharMap:
    """A compiled character map: a double-array trie of prefixes and their zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if blob else []
        self.texts = blob[4 + size :] if blob else b""

    def longest(self, text: bytes, start: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest mapped prefix at ``start``."""
        if not self.units:
            return None
        found, at = None, self._offset(self.units[0])
        for i in range(start, len(text)):
            at ^= text[i]
            unit = self.units[at] if at < len(self.units) else 0
            if unit & 0x800000FF != text[i]:
                break
            at ^= self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[at] & 0x7FFFFFFF
                found = i + 1 - start, self.texts[value : self.texts.index(b"\0", value)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The mapped text and, for each of its bytes and its end, the source byte where that prefix starts."""
        if not self.units:
            return text, np.arange(len(text) + 1)
        out, source, at = bytearray(), [], 0
        while at < len(text):
            n, new = self.longest(text, at) or (_char_length(text[at]), None)
            new = text[at : at + n] if new is None else new
            out += new
            source += [at] * len(new)
            at += n
        return bytes(out), np.array([*source, at])


def _char_length(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Codec:
    """Encodes and decodes with one model file."""

    def __init__(self, model_file: str, most: int = 400_000):
        raw = open(model_file, "rb").read()
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=raw)
        proto = model_pb2.ModelProto()
        proto.ParseFromString(raw)
        spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        kinds = model_pb2.ModelProto.SentencePiece
        self.surface = [
            bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL else p.piece.replace(BLANK, " ").encode()
            for p in proto.pieces
        ]
        self.blank_first = np.array([p.piece.startswith(BLANK) for p in proto.pieces])
        self.lengths = np.array([len(x) for x in self.surface])
        self.digits = np.zeros((len(self.surface), 7), np.uint8)
        for i in range(len(self.surface)):
            self.digits[i, : len(str(i)) + 1] = np.frombuffer(b"%d," % i, np.uint8)
        self.chunked = (
            not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
            and not proto.trainer_spec.treat_whitespace_as_suffix and proto.trainer_spec.byte_fallback and len(proto.pieces) < 65536
            and not any(p.type == kinds.USER_DEFINED or BLANK in p.piece.lstrip(BLANK) for p in proto.pieces)
        )
        self.most, self.seen = most, {}

    def _learn(self, chunks: list[bytes]) -> None:
        """Remember the ids of new chunks, as little-endian 16-bit numbers."""
        if len(self.seen) + len(chunks) > self.most:
            self.seen.clear()
        single = [c for c in chunks if c[1:2] != b" "]
        for at in range(0, len(single), 500):
            some = single[at : at + 500]
            # the library puts the first blank; every chunk begins with the only piece of it that starts with a blank
            ids = np.array(self.processor.encode(b"".join(some)[1:].decode() or "", num_threads=1), "<u2")
            starts = np.flatnonzero(self.blank_first[ids])
            if len(starts) == len(some):
                raw, cuts = ids.tobytes(), [*(2 * starts).tolist(), 2 * len(ids)]
                self.seen.update(zip(some, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
            else:
                chunks = [*chunks, *some]
        for c in chunks:
            if c not in self.seen:
                ids = self.processor.encode(c[1:].decode()) or [self.processor.piece_to_id(BLANK)]
                self.seen[c] = np.array(ids, "<u2").tobytes()

    def encode_batch(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: ids, first and end source byte of every piece."""
        if not self.chunked:
            return [self._encode_whole(t) for t in texts]
        out = []
        for at in range(0, len(texts), 64):
            plain = []
            for text in texts[at : at + 64]:
                line = b" " + self.map.normalise(text)[0].replace(BLANK.encode(), b" ") if text else b""
                if b"  " in line or line.endswith(b" "):
                    plain.append((line, _CHUNK.findall(line)))
                else:
                    plain.append((line, line.replace(b" ", b"\0 ").split(b"\0")[1:] if b"\0" not in line else _CHUNK.findall(line)))
            new = set().union(*(c for _, c in plain)).difference(self.seen)
            if len(self.seen) + len(new) > self.most:
                new = set().union(*(c for _, c in plain))
            self._learn(list(new))
            for text, (line, chunks) in zip(texts[at : at + 64], plain):
                ids = np.frombuffer(b"".join(map(self.seen.__getitem__, chunks)), "<u2")
                ends = np.cumsum(self.lengths[ids])
                if len(ids) and ends[-1] != len(line):
                    raise ValueError("pieces do not cover the text")
                out.append((ids.astype(np.int32), *self._source_spans(text, line, ends)))
        return out

    def _source_spans(self, text: bytes, line: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans in ``text`` of pieces that end at ``ends`` of ``line`` (the text with a blank before it)."""
        at = np.empty(len(ends) + 1, np.int32)
        at[0] = 0
        at[1:] = ends
        at = np.maximum(at - 1, 0)
        if len(line) - 1 != len(text) and text:  # blanks that took three bytes are single in `line`
            at = _positions(text)[at].astype(np.int32)
        return at[:-1], at[1:]

    def _encode_whole(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A model that is not chunked: pieces of the library, projected through the character map's alignment.

        Blanks at the ends and repeated blanks may be dropped by such a model; a
        dropped blank belongs to the span of the piece after it.
        """
        ids = self.processor.encode(text.decode())
        normal, source = self.map.normalise(text)
        at, begins, ends = 0, [], []
        for i in ids:
            want = self.surface[i]
            first = at
            for byte in want:
                if byte == 32 and (at >= len(normal) or normal[at] != 32):
                    continue  # the blank that encoding adds
                while normal[at : at + 1] == b" " and byte != 32:
                    at += 1
                at += 1
            begins.append(int(source[min(first, len(normal))]))
            ends.append(int(source[min(at, len(normal))]))
        return tuple(np.array(x, np.int32) for x in (ids, begins, ends))

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        cells = self.digits[ids]
        return cells[cells > 0].tobytes()[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ``ids``: surfaces of the pieces, without the blank that encoding put first."""
        if not self.chunked:
            return self.processor.decode(ids.tolist()).encode()
        text = b"".join(map(self.surface.__getitem__, ids.tolist()))
        text = text[1:] if text[:1] == b" " else text
        return text if text.isascii() else text.decode("utf-8", "replace").encode()


def _positions(normal: bytes) -> np.ndarray:
    """For each byte of the text with its three-byte blanks made single, and its end, the byte in ``normal``."""
    keep = np.ones(len(normal) + 1, bool)
    i = normal.find(BLANK.encode())
    while i >= 0:
        keep[i + 1 : i + 3] = False
        i = normal.find(BLANK.encode(), i + 3)
    return np.flatnonzero(keep)


@functools.lru_cache(2)
def codec(model_file: str) -> Codec:
    return Codec(model_file)


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """doc_id, ids, begins, ends (byte spans of the pieces in the original text) and, if wanted, the decoded text."""

    def run(batches):
        c = codec(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = c.encode_batch([t or b"" for t in batch.column(1)[at : at + 500].cast(pa.binary()).to_pylist()])
                cols = [batch.column(0)[at : at + 500], *(_lists([x[k] for x in found]) for k in range(3))]
                if decode:
                    cols.append(pa.array([c.decode(x[0]).decode() for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "begins", "ends", "decoded"][: len(cols)])

    schema = "doc_id long, ids array<int>, begins array<int>, ends array<int>" + ", decoded string" * decode
    return _columns(docs, id_col, text_col).mapInArrow(run, schema)


def encoding_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_cover (whether the spans tile the whole text)."""

    def run(batches):
        c = codec(model_file)
        for batch in batches:
            n, ids, decoded, cover = [], [], [], []
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for text, found in zip(texts, c.encode_batch(texts)):
                n.append(len(found[0]))
                ids.append(hashlib.sha256(c.decimal(found[0])).hexdigest())
                decoded.append(hashlib.sha256(c.decode(found[0])).hexdigest())
                cover.append(not text or bool(found[1][0] == 0 and found[2][-1] == len(text) and (found[1][1:] == found[2][:-1]).all()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded), pa.array(cover)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_cover"])

    return _columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_cover boolean")


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(a) for a in arrays], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *arrays]).astype(np.int32)))
