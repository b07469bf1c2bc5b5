import base64
import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from assay.llm import token_count

MODEL, RANKS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = [*"ab  ▁eéth\n\t0<s>x中文字😀inǵ\0 oiñ", "the", "<0x0A>", "<unk>", "</s>", "    ", "aaaa", "ing "]


@pytest.fixture(scope="module")
def strange():
    rng = random.Random(5)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 2, 5, 30, 300]))) for _ in range(1500)]
    out += [" " * k for k in range(40)] + ["a" * k for k in range(60)]
    # single sequences beyond LONG: of blanks (pieces of one score), of one letter, of random letters
    return [*out, " " * 3000 + "x", "a" * 5000, "ab" * 2000, "".join(rng.choice("etaoinshrdlu") for _ in range(20_000)), "▁" * 700]


def test_counts_equal_the_library(strange):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_count.PieceCounter(MODEL).counts([t.encode() for t in strange])
    assert got.tolist() == [len(library.encode(t)) for t in strange]


def test_byte_ranks_equal_the_library(strange):
    with open(RANKS, "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    got = token_count.ByteCounter(RANKS, public_tokenizers.PATTERN).counts([t.encode() for t in strange])
    assert got.tolist() == [len(library.encode_ordinary(t)) for t in strange]


def one_by_one(ranks, text):
    """The best pair, the leftmost of equals, again and again."""
    symbols = list(text)
    while True:
        found = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in ranks), default=None)
        if found is None:
            return len(symbols)
        symbols[found[1] : found[1] + 2] = [symbols[found[1]] + symbols[found[1] + 1]]


def test_rounds_equal_single_merges_for_any_ranks():
    import numpy as np

    rng = random.Random(9)
    for _ in range(60):
        tokens = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(25)}
        # ranks in any order, some of them equal, and some single letters ranked, too
        ranks = {t: rng.randint(0, 12) for t in [*tokens, "a", "b", "c"]}
        merges = token_count.Merges(ranks)
        texts = ["".join(rng.choice("abc") for _ in range(rng.choice([1, 3, 9, 40, 400]))) for _ in range(40)]
        symbols = np.array([merges.symbol[c] for t in texts for c in t], np.int32)
        sizes = np.array([len(t) for t in texts])
        _, owner = merges.survivors(symbols, np.cumsum(sizes) - sizes)
        assert np.bincount(owner, minlength=len(texts)).tolist() == [one_by_one(ranks, t) for t in texts]


def test_query_edges(spark, edges):
    out = sorted(map(tuple, token_count.token_counts(edges.withColumn("n_tokens", edges.n_chars), MODEL).collect()), key=repr)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(r["doc_id"], r["text"] or "") for r in edges.collect()]
    assert out == sorted(((i, len(t.encode()), n, n > 4096) for i, t in rows for n in [len(library.encode(t))]), key=repr)
    assert token_count.token_counts(edges.limit(0), MODEL).count() == 0
    with pytest.raises(ValueError):
        token_count._counter("words.json", None)
