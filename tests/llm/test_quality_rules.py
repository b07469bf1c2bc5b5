import re
from collections import Counter

from assay.llm import quality_rules as q


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    joined = "".join(words)
    return len(words), len(joined), sum(c in "#*$%&|<>" for c in joined), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark, make, prose):
    texts = [None, "", " \n ", "a b c a b c", "x x x x x", "é # é\t*|\n\nq\nq\r\nq", "a\x0bb\x0cc\xa0d", *(prose(k, 20 * k + 1) for k in range(12))]
    texts += [t + "\n" + t for t in texts[7:10]]
    out = q.quality_rules(make(list(enumerate(texts)))).collect()
    got = {r["doc_id"]: r for r in out}
    for k, text in enumerate(texts):
        r = got[k]
        n, chars, symbols, dup, repeat = counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_frequent_lines_deplete_documents(spark, make, prose):
    banner = "This banner " + "stands on every page " * 20
    rows = [(k, prose(k, 120), "a") for k in range(40)]
    rows += [(100 + k, banner + f"\npage number {k}", "b") for k in range(40)]
    rows += [(200 + k, prose(999, 120), "a") for k in range(300)]  # exact copies are one document
    got = {r["doc_id"]: r for r in q.quality_rules(make(rows)).collect()}
    assert all(got[k]["kept"] for k in range(40)) and all(got[200 + k]["kept"] for k in range(300))
    assert all(got[100 + k]["depleted"] and not got[100 + k]["kept"] and got[100 + k]["removed_lines"] == 1 for k in range(40))


def test_edges(spark, edges):
    extra = edges.withColumnsRenamed({"lang": "words", "n_chars": "line"})
    out = q.quality_rules(extra).collect()
    assert len(out) == 9 and not any(r["kept"] for r in out if r["n_words"] < 50)
    assert q.quality_rules(edges.limit(0)).count() == 0
    assert q.quality_rules(edges.withColumn("source", edges.source.substr(9, 1)).replace("", None)).count() == 9
