import random
import re
from collections import Counter, defaultdict

from assay.llm import collocations


def brute_force(rows, top, least, longest=4, share=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = set()
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * candidates[q] >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in candidates):
                continue
            score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, lang, text, "x", "y") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n string")


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = "the of new york city in united states san é Él a\0b x y big red".split(" ")
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            words.append(rng.choice(["New York City", "united  states", "in\tthe", "of the", rng.choice(vocabulary), f"w{rng.randrange(500)}"]))
        yield rng.choice(["en", "de", None, "und"]), "".join(w + rng.choice([" ", " ", " ", ", ", ".\n", "\r", "\t", "!"]) for w in words)


def test_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(collocations, "STRETCH", 2_000)  # many stretches
    rows = [*texts(1, 300), ("en", None), (None, ""), ("fr", " \t\n.,"), ("en", "one " * 20_000), ("it", "ab cd " * 40)]
    for top, least in ((2000, 5), (7, 3)):
        got = collocations.collocations(table(spark, rows).repartition(5), top=top, least=least).collect()
        assert set(map(tuple, got)) == brute_force(rows, top, least) and len(got) == len(set(got))


def test_ranks_of_parts_are_ranks_of_all(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PER_TASK", 3)
    rows = list(texts(2, 200))
    assert set(map(tuple, collocations.collocations(table(spark, rows), top=10, least=3).collect())) == brute_force(rows, 10, 3)


def test_full_buckets_lose_nothing(spark, monkeypatch):
    """Bitmaps far too small for the data only cost counting."""
    monkeypatch.setattr(collocations, "RANGE_BITS", 4)
    monkeypatch.setattr(collocations, "MOST_BITS", 4)
    rows = list(texts(3, 150))
    assert set(map(tuple, collocations.collocations(table(spark, rows), least=3).collect())) == brute_force(rows, 2000, 3)


def test_products_beyond_64_bits(spark):
    big = 3 * 10**13
    counts = [spark.createDataFrame([("en", p, n) for p, n in part], "lang string, phrase string, f long") for part in ([("a", big), ("b", big + 1), ("c", big)], [("a b", big - 1), ("b c", 10**7)], [("a b c", 10**6)], [("x y z w", 1)])]
    got = {r["phrase"]: r["score"] for r in collocations.scored(counts).collect()}
    assert got["a b"] == 2_000_000 * (big - 1) // (2 * big + 1) and got["a b c"] == min(2_000_000 * 10**6 // (big + 10**7), 2_000_000 * 10**6 // (big - 1 + big))
    assert {r["phrase"] for r in collocations.explained([c.withColumn("f", c.f * 0 + 2 * 10**17) for c in counts], 80).collect()} == {"a b", "b c"}


def test_empty(spark):
    assert collocations.collocations(table(spark, [("en", "a")]).limit(0)).count() == 0
