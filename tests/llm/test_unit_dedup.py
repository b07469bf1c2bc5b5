from pyspark.sql import functions as F

from assay.llm import unit_dedup as u


def brute_force(rows, least_unit=3, least_run=20):
    first, out = {}, set()
    for doc_id, text in sorted(rows):
        for pos, (_, _, _, normal) in enumerate(u.text_units(text or "", "sentence", least_unit)):
            first.setdefault(normal, (doc_id, pos))
    for doc_id, text in rows:
        run = []
        for pos, (b, e, n, normal) in [*enumerate(u.text_units(text or "", "sentence", least_unit)), (-1, (0, 0, 0, None))]:
            if normal is not None and first[normal] != (doc_id, pos):
                run.append((b, e, n))
                continue
            if sum(r[2] for r in run) >= least_run:
                out.add((doc_id, run[0][0], run[-1][1]))
            run = []
    return out


def test_spans_equal_brute_force(spark, make, prose):
    passage = prose(5, 70)
    rows = [(k, prose(100 + k, 90)) for k in range(12)]
    rows += [(20, prose(30, 40) + "\n" + passage + "\n" + prose(31, 40)), (21, passage), (22, prose(32, 20)[:60] + " " + passage + " " + prose(33, 20)), (23, rows[3][1].upper()), (24, None), (25, "")]
    got = u.repeated_spans(make(rows)).collect()
    assert {(r["doc_id"], r["begin"], r["end"]) for r in got} == brute_force(rows)
    hit = {r["doc_id"] for r in got}
    assert {21, 22, 23} <= hit and not hit & set(range(12))
    assert all(r["first_doc_id"] == 20 for r in got if r["doc_id"] in (21, 22))


def test_lines_and_paragraphs(spark, make):
    block = "\n".join(f"line {k} of a block with many words in it" for k in range(4))
    docs = make([(1, "head one two\n\n" + block), (2, block + "\n\ntail one two"), (3, "alone as it is")])
    assert [(r["doc_id"], r["begin"], r["end"]) for r in u.repeated_spans(docs, kind="line").collect()] == [(2, 0, len(block))]
    assert [(r["doc_id"], r["begin"], r["end"]) for r in u.repeated_spans(docs, kind="paragraph").collect()] == [(2, 0, len(block))]


def test_cutting(spark, make):
    docs = make([(1, "0123456789"), (2, None), (3, "é漢😀x")])
    spans = spark.createDataFrame([(1, 2, 5), (1, 4, 6), (1, 6, 7), (3, 1, 3)], "doc_id long, begin int, end int")
    spans = spans.join(docs.select("doc_id", F.xxhash64("text").alias("content")), "doc_id")
    out = {r["doc_id"]: r["text"] for r in u.without_spans(docs, spans).collect()}
    assert out == {1: "01789", 2: None, 3: "éx"}
    assert u.without_spans(docs, spans).columns == docs.columns


def test_edges(spark, edges):
    wide = edges.withColumnsRenamed({"lang": "pos", "source": "h1"})
    got = u.repeated_spans(wide).collect()
    assert {r["doc_id"] for r in got} <= {7, 8}
    assert u.without_spans(wide, u.repeated_spans(wide)).count() == 9
    assert u.repeated_spans(edges.limit(0)).count() == 0
