import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from assay.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a b", "a  b ", "a\nb", "\n", "▁", "▁▁a b▁c", "é ü 漢字 😀", "a\tb", "\x00a", "<s> a </s>", "<unk><0x41>", "x" * 3000, "日本語 テキスト  ", "é ́x"]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(MODEL)


def test_same_as_library(codec, prose):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = TEXTS + [prose(k, 200) for k in range(20)]
    for text, (ids, begins, ends) in zip(texts, codec.encode_batch([t.encode() for t in texts])):
        assert ids.tolist() == library.encode(text)
        assert codec.decode(ids).decode() == library.decode(ids.tolist())
        assert codec.decimal(ids).decode() == ",".join(map(str, ids.tolist()))
        raw = text.encode()
        if raw:
            assert begins[0] == 0 and ends[-1] == len(raw) and (begins[1:] == ends[:-1]).all()
        for i, b, e in zip(ids.tolist(), begins.tolist(), ends.tolist()):
            surface = codec.surface[i].replace(b" ", b"")
            assert raw[b:e].replace(b" ", b"").replace("▁".encode(), b"") == surface


def test_small_memory_gives_the_same(codec, prose):
    small = pieces.Codec(MODEL, most=50)
    texts = [prose(k, 300).encode() for k in range(6)]
    for a, b in zip(codec.encode_batch(texts), small.encode_batch(texts)):
        assert a[0].tolist() == b[0].tolist()


def darts(words):
    """A character map with one-byte and two-byte keys, laid out by hand: blocks of 256 units for the children of a node."""
    units, texts = {}, b""
    values = {}
    for key, new in words.items():
        values[key] = len(texts)
        texts += new + b"\0"

    def node(prefix, base):
        for c in {k[len(prefix)] for k in words if k.startswith(prefix) and len(k) > len(prefix)}:
            child, at = prefix + bytes([c]), base ^ c
            target = node.next
            node.next += 256
            leaf = child in words
            units[at] = ((at ^ target) << 10) | (leaf << 8) | c
            if leaf:
                units[target] = 0x80000000 | values[child]
            node(child, target)

    node.next = 512
    units[0] = 256 << 10
    node(b"", 256)
    flat = np.zeros(node.next + 256, "<u4")
    for at, unit in units.items():
        flat[at] = unit
    raw = flat.tobytes()
    return len(raw).to_bytes(4, "little") + raw + texts


def test_character_map_takes_the_longest_prefix_and_keeps_sources():
    m = pieces.CharMap(darts({b"a": b"x", b"ab": b"yy", "é".encode(): b"e"}))
    text, source = m.normalise("abaéz漢".encode())
    assert text == "yyxez漢".encode()
    assert source.tolist() == [0, 0, 2, 3, 5, 6, 6, 6, 9]
    assert m.longest(b"abc", 0) == (2, b"yy") and m.longest(b"zz", 0) is None


def test_operator_and_digests(spark, edges):
    wide = edges.withColumnsRenamed({"lang": "ids", "source": "decoded"})
    full = pieces.encode_documents(wide, MODEL).collect()
    digests = pieces.encoding_digests(wide, MODEL).collect()
    assert len(full) == len(digests) == 9
    for r in full:
        want = hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest(), hashlib.sha256(r["decoded"].encode()).hexdigest()
        assert (r["doc_id"], len(r["ids"]), *want, True) in {tuple(d) for d in digests}
    assert pieces.encode_documents(wide.limit(0), MODEL).count() == 0
