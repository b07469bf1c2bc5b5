import random
import re
import zlib
from collections import Counter

import pytest

from assay.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        others = [v for v in counts if near(v, w)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        out[w] = (best if best and counts[best] >= ratio * n else None, n, len(others))
    rows = set()
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, k, counts[form] if form else None))
    return rows


def random_words(seed, n, letters="abcé"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, 9))) for _ in range(n)}
    for w in list(words):
        for _ in range(2):
            i, c = rng.randrange(len(w) + 1), rng.choice(letters)
            words.add(rng.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]]))
    words |= {"a" * k for k in range(7, 12)} | {"b" * 60 + "c", "b" * 60, "b" * 59 + "cc"}
    return {w: rng.choice([2, 3, 30, 400, 5000]) for w in words if len(w) >= 7}


@pytest.mark.parametrize("most", [20_000, 5])
def test_variants_equal_brute_force(spark, most):
    """With ``most`` = 5 nearly all keys are halved down to windows of one place."""
    counts = random_words(3, 250)
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert set(map(tuple, spelling.variants(table, most=most).collect())) == brute_force(counts)


def test_a_trie_finds_every_pair():
    for seed in range(5):
        words = list(random_words(seed, 60))
        found = {frozenset(p) for p in spelling.near_in_trie(dict.fromkeys(words, 0))}
        assert found == {frozenset((a, b)) for a in words for b in words if near(a, b)}


def test_chains_end_at_the_root(spark):
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20_000, "zzzzzzz": 2}
    rows = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert rows == {w: ("zzzzzzz" if w[0] == "z" else "abcdefghijk") for w in counts}


def test_texts_equal_brute_force(spark, make, prose):
    rows = [(k, prose(k, 300).replace("the", "ThÉ")) for k in range(30)] + [(90, None), (91, ""), (92, "short words only"), (None, "missing missing Missing"), (93, "1nterior_exterior-exterior ŁÀÖéèêëexterior")]
    rows += [(94, "exterior " * 5000)] * 2
    words = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            words[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = brute_force({w: n for w, n in words.items() if len(w) >= 7 and n >= 2})
    docs = make(rows).withColumnsRenamed({"lang": "word", "source": "run"})
    assert set(map(tuple, spelling.spelling_variants(docs).collect())) == want
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
