import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def prose():
    """Reproducible invented prose: prose(seed, words)."""
    parts = "the an re on er th tion ing ed ou ha st en at nd or wh ti es ea".split()

    def build(seed, n):
        rng = random.Random(seed)
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]
        out = []
        while words:
            k = rng.randint(5, 12)
            out.append(" ".join(words[:k]).capitalize() + ".")
            words = words[k:]
        lines, at = [], 0
        while at < len(out):
            k = rng.randint(1, 4)
            lines.append(" ".join(out[at : at + k]))
            at += k
        return "\n".join(lines)

    return build


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (None, "no id here at all"), (7, "same text here"), (7, "same text here")]


@pytest.fixture()
def edges(make):
    """Nulls, blanks, tiny texts, a missing id, a repeated row, and one very long text."""
    return make([*EDGES, (8, "word " * 50_000)])
