import random

import numpy as np

from assay.llm import decontaminate as d


def semi_global(item, text):
    """Least edits of item against any part of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edit(text, n, seed):
    rng, out = random.Random(seed), list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[at : at + (kind != 1)] = [] if kind == 0 else ["z"]
    return "".join(out)


def test_matches_equal_brute_force(spark, make, prose):
    items = [(k, prose(900 + k, 25 + 3 * k)) for k in range(8)]
    bench = spark.createDataFrame([*items, (90, None), (91, "short")], "item_id long, text string")
    rows = []
    for k in range(40):
        text = prose(k, 60)
        if k % 2:
            cut = len(text) // 3
            text = text[:cut] + edit(items[k % 8][1], k // 4, k) + text[cut:]
        rows.append((k, text))
    rows += [(50, None), (51, ""), (52, items[2][1].upper()), (53, items[3][1].replace(" ", "\n"))]
    got = {(r["doc_id"], r["item_id"]) for r in d.contaminated_spans(make(rows), bench).collect()}
    index = d.Index(items)
    want = set()
    for doc_id, text in rows:
        for k, (item_id, _) in enumerate(items):
            folded = d.folded((text or "").encode())
            if semi_global(index.texts[k].tolist(), folded.tolist()) <= index.edits[k]:
                want.add((doc_id, item_id))
    assert got == want and len(want) > 15


def test_spans_and_blocks(spark, make, prose, monkeypatch):
    item = prose(1, 30)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    text = "é漢 " + prose(2, 30) + " " + item + " " + prose(3, 30)
    r = d.contaminated_spans(make([(1, text)]), bench).collect()
    assert [(x["doc_id"], x["item_id"], x["edits"]) for x in r] == [(1, 7, 0)] and text[r[0]["begin"] : r[0]["end"]] == item
    # several parts of a benchmark, and texts cut into parts, find the same
    many = spark.createDataFrame([(k, prose(k, 30)) for k in range(5)], "item_id long, text string")
    docs = make([(k, prose(50, 20) + " " + prose(k, 30) + prose(51, 500)) for k in range(5)])
    whole = sorted(map(tuple, d.contaminated_spans(docs, many).collect()))
    assert [(x[0], x[2]) for x in whole] == [(k, k) for k in range(5)]
    assert sorted(map(tuple, d.contaminated_spans(docs, many, part_bytes=200).collect())) == whole
    monkeypatch.setattr(d, "BLOCK_BYTES", 300)
    index, texts = d.Index([(k, prose(k, 30)) for k in range(5)]), [(prose(50, 20) + " " + prose(k, 30) + prose(51, 500)).encode() for k in range(5)]
    found = set()
    for which, at, block in d.blocks(texts, index.longest):
        for item, begin, _, _ in index.spans(block):
            k = int(np.searchsorted(at, begin, "right")) - 1
            found.add((which[k][0], item))
    assert found == {(k, k) for k in range(5)}


def test_edges(spark, edges):
    bench = spark.createDataFrame([(1, "word " * 30)], "item_id long, text string")
    got = d.contaminated_spans(edges.withColumnsRenamed({"lang": "item_id", "source": "begin"}), bench).collect()
    assert {r["doc_id"] for r in got} == {8}
    assert d.contaminated_spans(edges, bench.limit(0)).count() == 0 and d.contaminated_spans(edges.limit(0), bench).count() == 0


def test_truncated_items_at_the_ends_of_documents(spark, make, prose):
    """Found in every document, wherever it lies in its block."""
    item = prose(5, 40)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    most, texts = int(d.Index([(7, item)]).edits[0]), [prose(80, 20)]
    for cut in (1, 2, 3, most, most + 1):
        texts += [item[cut:] + " " + prose(81 + cut, 30), prose(82 + cut, 30) + " " + item[:-cut], item[cut:], item[:-cut]]
    folded = d.folded(item.encode()).tolist()
    want = {k for k, t in enumerate(texts) if semi_global(folded, d.folded(t.encode()).tolist()) <= most}
    assert len(want) == 16
    for order in (list(range(len(texts))), list(range(len(texts)))[::-1]):
        rows = d.contaminated_spans(make([(k, texts[k]) for k in order]).coalesce(1), bench).collect()
        assert {r["doc_id"] for r in rows} == want and len(rows) == len(want)
        assert all(0 <= r["begin"] < r["end"] <= len(texts[r["doc_id"]]) and r["end"] - r["begin"] >= len(item) - 2 * most for r in rows)


def test_short_items_and_best_spans(spark, make):
    """Items without a gram are found as whole words, and of overlapping occurrences the one with the fewest edits counts."""
    item = "the quick brown fox jumps over the lazy dog near the river bank today"
    near = item.replace("quick", "quack")
    docs = make([(1, "Forty  Two is it"), (2, "forty two is it"), (3, "xforty two, forty two."), (4, near[:40] + " " + item + " end"), (5, None)])
    bench = spark.createDataFrame([(1, " Forty two "), (2, item), (3, ""), (4, None), (5, "is")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["begin"], r["end"], r["edits"]) for r in d.contaminated_spans(docs, bench).collect())
    assert got == [(1, 5, 11, 13, 0), (2, 1, 0, 9, 0), (2, 5, 10, 12, 0), (3, 1, 12, 21, 0), (4, 2, 41, 41 + len(item), 0)]
    assert d.contaminated_spans(docs, bench.limit(0)).count() == 0 and d.contaminated_spans(docs.limit(0), bench).count() == 0


def test_short_items_with_an_edit(spark, make):
    """Items of 20 to 23 bytes may have one edit, anywhere."""
    rng = random.Random(6)
    items = [(m, "".join(rng.choice("abcdefgh ") for _ in range(m)).replace(" ", "x")) for m in range(12, 30)]
    index = d.Index(items)
    for m, item in items:
        most = int(m * d.EDIT_SHARE)
        for at in range(m):
            for text in (item[:at] + "z" + item[at:], item[:at] + "z" + item[at + 1 :], item[:at] + item[at + 1 :]):
                found = [s for s in index.spans(d.folded(("q" * 40 + text + "q" * 40).encode())) if s[0] == m]
                least = semi_global(list(item.encode()), list(("q" * 40 + text + "q" * 40).encode()))
                assert [s[3] for s in found] == ([least] if least <= most else []), (m, at, text)
    got = d.contaminated_spans(make([(1, "qq " + items[8][1][:10] + "-" + items[8][1][11:])]), spark.createDataFrame([items[8]] * 50, "item_id long, text string")).collect()
    assert [(r["item_id"], r["edits"]) for r in got] == [(20, 1)]
