"""Hashed features of texts, for a batch of texts at once.

A batch is split and its different tokens are coded by Arrow; hashes, shapes and beginnings are made once for each
different token as arrays, so a task's work grows with what is new in a batch and its memory with the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Buckets of hashed features; weights are vectors of this fixed size.
DIM = 1 << 18
#: Bytes of a word that make a beginning, and numbers of different words with one beginning that make features of their own.
STARTS, TIERS = (3, 4, 5, 6, 7), (2, 4)
TRIM = " \t\n.,;:!?\"'()[]{}|*#%$&<>-_…«»“”„"
#: Characters of texts that are handled together.
STRETCH = 4 << 20


def stretches(texts: list[str | None]):
    """Lists of texts of some megabytes; a longer text is a list of its own."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size > STRETCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bytes(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begins, sizes) of the strings of an array without nulls."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at[:-1], np.diff(at)


def word_terms(words: pa.StringArray) -> np.ndarray:
    """A row for each word: the bucket of the word and of its beginnings, -1 where it is not longer than these."""
    data, begin, size = _bytes(words)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.full((len(words), 1 + len(STARTS)), -1, np.int64)
    if not len(words):
        return out
    head = np.zeros((len(words), 8), np.uint8)
    for k in range(8):
        head[:, k] = np.where(size > k, data[np.minimum(begin + k, len(data) - 1)], 0)
    head = head.view("<u8").reshape(-1)
    # the whole word: its bytes times powers by place, summed
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
    power = _mixed(np.arange(1, int(size.max(initial=0)) + 1, dtype=np.uint64))
    terms = (data[np.repeat(begin, size) + place].astype(np.uint64) + np.uint64(1)) * power[place]
    whole = np.zeros(len(words), np.uint64)
    some = size > 0
    whole[some] = np.add.reduceat(terms, (np.cumsum(size) - size)[some])
    out[:, 0] = np.where(some, (_mixed(whole ^ size.astype(np.uint64)) % np.uint64(DIM)).astype(np.int64), -1)
    for j, n in enumerate(STARTS):
        part = _mixed((head & np.uint64((1 << 8 * n) - 1)) + np.uint64(n << 57))
        out[:, j + 1] = np.where(size > n, (part % np.uint64(DIM)).astype(np.int64), -1)
    return out


def shapes(tokens: pa.StringArray) -> np.ndarray:
    """Bucket of each token's shape: runs of upper-case letters are A, of others a, of digits 9; marks stay."""
    for pattern, to in ((r"[\p{Ll}\p{Lo}\p{Lm}\p{Lt}]+", "a"), (r"\p{Lu}+", "A"), (r"\p{Nd}+", "9")):
        tokens = pc.replace_substring_regex(tokens, pattern, to)
    coded = pc.utf8_slice_codeunits(tokens, 0, 40).dictionary_encode()
    buckets = np.array([bucket("shape " + s) for s in coded.dictionary.to_pylist()], np.int64)
    return buckets[coded.indices.to_numpy()] if len(tokens) else np.zeros(0, np.int64)


def bucket(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) % DIM


class Features:
    """Features of some texts: ``doc`` and ``at`` (text number and bucket, sorted by text; a term counts once in a text), and of all
    tokens in order ``token_doc`` and ``token`` (number of the different token), with ``tokens``, the different ones."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        split = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        token, doc = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(self.n), np.diff(offsets))
        self.tokens = coded.dictionary
        filled = pc.utf8_length(self.tokens).to_numpy(zero_copy_only=False) > 0
        ok = filled[token] if len(token) else np.zeros(0, bool)
        self.token, self.token_doc = token[ok], doc[ok]
        words = pc.utf8_trim(pc.utf8_lower(self.tokens), TRIM).dictionary_encode()
        word = words.indices.to_numpy().astype(np.int64)
        n_words = len(words.dictionary)
        pairs = np.unique(self.token_doc * n_words + word[self.token]) if len(self.token) else np.zeros(0, np.int64)
        terms = word_terms(words.dictionary)
        doc, at = np.repeat(pairs // max(n_words, 1), terms.shape[1]), terms[pairs % max(n_words, 1)].reshape(-1)
        keys, counts = np.unique((doc * DIM + at)[at >= 0], return_counts=True)
        doc, at = keys // DIM, keys % DIM
        tiers = [(doc[counts >= k], (at[counts >= k] * 31 + 7919 * k) % DIM) for k in TIERS]
        doc, at = np.concatenate([doc, *(d for d, _ in tiers)]), np.concatenate([at, *(a for _, a in tiers)])
        order = np.argsort(doc, kind="stable")
        self.doc, self.at = doc[order], at[order]

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """For each text the sum of the weights of its terms."""
        return np.bincount(self.doc, weights[self.at], self.n)

    def rows(self) -> list[np.ndarray]:
        """The buckets of each text."""
        return np.split(self.at, np.searchsorted(self.doc, np.arange(1, self.n)))
