"""The pipeline against its stages' brute-force versions on a small corpus."""

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as p
from assay.llm import near_dup, quality_rules


@pytest.fixture(scope="module")
def sf(spark, make, prose, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    passage, item = prose(60, 70).rsplit(" ", 1)[0], prose(61, 40)  # without its last sentence of one word, which is no unit
    rows = [(k, prose(k, 100)) for k in range(20)]
    rows += [(20, rows[3][1]), (21, "too short"), (22, prose(70, 60) + "\n" + passage), (23, prose(71, 60) + "\n" + passage), (24, prose(72, 60) + " " + item + " " + prose(73, 60)), (25, None), (26, "a b c " * 40)]
    make(rows).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, dict(rows), passage, item


def test_stages_in_order():
    assert [name for name, _ in p.STAGES] == ["quality rules", "near-duplicates", "substring dedup", "decontamination", "encoding"]


def test_run(spark, sf):
    root, texts, passage, item = sf
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, root)
        assert docs.columns == before.columns
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {k: t for k, t in texts.items() if k not in (20, 21, 25, 26)}
    want[23] = want[23].replace(passage, "")
    want[24] = want[24].replace(item, "")
    assert kept == want
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = p.run(spark, root).collect()
    assert {r["doc_id"]: r["ids"] for r in out} == {k: library.encode(t) for k, t in want.items()}
    assert all(len(r["ids"]) == r["n_tokens"] == len(r["begins"]) == len(r["ends"]) for r in out)


def test_empty_table(spark, sf):
    root, *_ = sf
    docs = spark.read.parquet(f"{root}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, root).count() == 0


def test_quality_stage_cuts_frequent_lines(spark, make, prose):
    """A line above its host's limit leaves the documents that stay; other lines and hosts keep it."""
    line = "Subscribe to our  letter today"
    rows = [(k, f"{prose(k, 60)}\n {line.upper()}\t\n\n{prose(k + 500, 20)}\n{line}", "a") for k in range(30)] + [(90, f"{line}\n{prose(90, 60)}", "b"), (91, prose(91, 60), "a")]
    got = {r["doc_id"]: r for r in p.quality(spark, make(rows), "").collect()}
    want = {k: t if k >= 90 else f"{prose(k, 60)}\n\n{prose(k + 500, 20)}" for k, t, _ in rows}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(want[k]) for k, r in got.items())
    docs = make(rows)
    counts = quality_rules.text_counts(docs)
    cut = {r["doc_id"]: r for r in quality_rules.cleaned_texts(docs, counts, quality_rules.frequent_lines(counts)).collect()}
    lines = dict((k, t.split("\n")) for k, t, _ in rows)
    assert all(r["removed"] == ([i for i, x in enumerate(lines[k]) if "letter" in x.lower()] if k < 90 else None) for k, r in cut.items())


def test_near_duplicate_stage_takes_five_words_and_four_fifths(spark, make, prose):
    """Texts with a block appended fall from 0.82 on; scattered edits that only three-word shingles forgive do not count."""
    rows, want = [], set()
    for k in range(40):
        text = prose(k, 10 if k % 4 == 0 else 40 + 15 * (k % 8)).split()
        more = prose(700 + k, 200).split()
        grown = text + more[: max(1, len(text) * (16 + k % 14) // 100)]
        edited = [w if i % 45 != 20 else "changed" for i, w in enumerate(text)]
        rows += [(3 * k, " ".join(text)), (3 * k + 1, " ".join(grown)), (3 * k + 2, " ".join(edited) + " " + " ".join(more[-(len(text) // 9) :]))]
    sets = {k: set(near_dup.shingle_set(t.encode(), 5).tolist()) for k, t in rows}
    leader = {k: k for k in sets}
    between = 0
    for x in sorted(sets):
        for y in sorted(sets):
            share = len(sets[x] & sets[y]) / len(sets[x] | sets[y])
            if x < y and share >= 0.8:
                between += share < 0.85
                low, high = sorted((leader[x], leader[y]))
                leader = {k: low if v == high else v for k, v in leader.items()}
    want = {k for k, v in leader.items() if k == v}
    assert between > 10 and len(want) < 110
    assert {r["doc_id"] for r in p.near_duplicates(spark, make(rows), "").collect()} == want


def test_encoding_stage_decodes(spark, make, prose):
    texts = {1: prose(1, 40), 2: "", 3: "é  漢 \U0001f600"}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["decoded"] for r in p.encoding(spark, make(list(texts.items())), "").collect()}
    assert got == {k: library.decode(library.encode(t)) for k, t in texts.items()}


def test_rows_that_share_an_id_or_have_none(spark, make, prose, tmp_path):
    """Each is judged, deduplicated and cut by its own text, and extra columns stay."""
    passage, item = prose(60, 70).rsplit(" ", 1)[0], prose(61, 40)
    good = [prose(200 + k, 90) for k in range(8)]
    rows = [
        (None, "short"), (None, good[0]), (None, good[1] + "\n" + passage), (7, good[2] + "\n" + passage), (7, good[3] + " " + item + " " + good[4]), (7, "too short"),
        (9, good[5]), (11, good[5]), (12, good[6]), (12, good[6]), (None, None),
    ]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make(rows).withColumns({"content": F.lit("c"), "begin": F.lit(1), "kept": F.lit(False)})
    for _, stage in p.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    got = sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect())
    want = [(0, good[0]), (0, good[1] + "\n" + passage), (7, good[2] + "\n"), (7, good[3] + "  " + good[4]), (9, good[5]), (12, good[6]), (12, good[6])]
    assert got == sorted(want)
    assert {r["content"] for r in docs.collect()} == {"c"}
    assert len(p.encoding(spark, docs, str(tmp_path)).collect()) == len(want)
