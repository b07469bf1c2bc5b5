import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assay.llm import token_store as ts

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_words_encode_as_the_library_does(library, prose):
    texts = ["", " ", "a", "A,b ,c,, d.", "don't it's 'S x's,", "<|endoftext|> a", "<|ENDOFTEXT|>", "É é, ﬁ Ⅷ İ ΑΣ. 漢字, 1234 ½ a1b2,", "é, ñ.", "x\x1cy\x0bz", "ſ K Å", "a.b. ..., -.", "\x00a.", *(prose(k, 200) for k in range(10))]
    for text, ids in zip(texts, ts.WordEncoder(FILE, most=100).encode_batch([t.encode() for t in texts])):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=200), min_size=1, max_size=6), st.data())
def test_shards_round_trip_and_random_access(docs, data):
    ids = [np.array(d + [2], "<u2") for d in docs]
    shard = ts.Shard(ts.pack(list(range(len(ids))), ids, 6))
    flat = np.concatenate(ids)
    assert [x.tolist() for _, x in shard.documents()] == [x.tolist() for x in ids]
    a = data.draw(st.integers(0, len(flat)))
    b = data.draw(st.integers(a, len(flat)))
    assert shard.ids(a, b).tolist() == flat[a:b].tolist()


def test_grammar_replaces_frequent_pairs():
    ids = np.array([1, 2, 3, 1, 2, 4] * 500 + [7] * 1001, "<u2")
    rules, seq = ts.grammar(ids, 10)
    assert len(seq) < len(ids) / 10 and [1, 2] in rules.tolist()
    assert ts.Shard(ts.pack([None], [ids], 10)).ids().tolist() == ids.tolist()


def test_digests_equal_brute_force(spark, make, prose, library):
    rows = [(k * 3 % 101, prose(k, 1 + k * 5)) for k in range(60)] + [(200, None), (201, ""), (202, "A b")]
    got = {r["doc_id"]: r for r in ts.stored_digests(make(rows), FILE).collect()}
    start = 0
    for doc_id, text in sorted(rows):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want = (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert tuple(got[doc_id][c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) == want
        start += len(ids)


def test_edges(spark, edges):
    out = ts.stored_digests(edges.withColumnsRenamed({"lang": "part", "source": "blob"}), FILE).collect()
    assert len(out) == 9 and sum(r["n_tokens"] for r in out) == max(r["start"] + r["n_tokens"] for r in out)
    assert min(out, key=lambda r: r["start"])["doc_id"] is None
    assert ts.stored_digests(edges.limit(0), FILE).count() == 0


def test_ids_do_not_depend_on_what_was_met_before(library):
    """Words of marks, digits and letters, with a comma or stop behind them, within and across batches."""
    rng = random.Random(5)
    parts = ["a", "é", "the", "-", "'", ")", '"', "...", "%", "*", "c++", "1", "ﬁ", "漢", "’s", "'s", "ß", "İ", "\x01", " ", "́", ",", "."]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) + rng.choice(["", ",", ".", ",.", ".,"]) for _ in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    coder = ts.WordEncoder(FILE, most=3000)
    for k in range(0, len(texts), 500):
        for text, ids in zip(texts[k : k + 500], coder.encode_batch([t.encode() for t in texts[k : k + 500]])):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_grammar_leaves_no_pair_twice():
    rng = np.random.default_rng(2)
    for ids in (rng.zipf(1.3, 30_000) % 70_000, rng.integers(0, 4, 5_000), np.repeat([7], 5_001), np.tile([1, 2, 3, 4, 5], 900)):
        first = int(ids.max()) + 1
        rules, seq = ts.grammar(ids.astype("<u4"), first)
        pairs, counts = np.unique(seq[:-1].astype(np.int64) << 32 | seq[1:], return_counts=True)
        assert all(a == b for a, b in zip((pairs[counts > 1] >> 32).tolist(), (pairs[counts > 1] & 0xFFFFFFFF).tolist()))  # overlaps only
        shard = ts.Shard(ts.pack([1], [ids.astype("<u4")], first))
        assert (shard.ids() == ids).all() and (shard.ids(17, 95) == ids[17:95]).all()
        assert len(ts.pack([1], [ids.astype("<u4")], first)) < 4 * len(ids)


def test_packed_values_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 70_000):
        for width in (1, 9, 17, 25, 32):
            values = rng.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
            assert (ts.unpacked(b"ab" + ts.packed(values, width), 2, n, width) == values).all()
