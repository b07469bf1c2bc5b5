"""Toxicity, ordinal quality, LM scores, license scan: held-out accuracy and defined results."""

import math
import random
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import hashed_text, license_scan, linear, lm_score, quality_model, toxicity

BAD = ["idiot", "moron", "scumbag", "trashy"]


@pytest.fixture(scope="module")
def labelled(spark, prose):
    rows, labels = [], []
    for k in range(600):
        text, toxic, junk = prose(k, 60), k % 6 == 0, k % 7 == 1
        if toxic:
            words = text.split(" ")
            for j in range(3):
                words.insert(5 + 9 * j, BAD[(k // 6 + j) % 4] + ("," if j else ""))
            text = " ".join(words)
        if junk:
            text = " | ".join(text.split())
        rows.append((k, text))
        labels.append((k, 0 if junk else 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_toxicity_on_held_out_rows(spark, labelled, edges):
    docs, labels = labelled
    extra = edges.withColumn("doc_id", edges.doc_id + 10_000).select("doc_id", "text", "lang", F.lit(1).alias("score"))
    got = toxicity.toxicity(docs.unionByName(extra, allowMissingColumns=True), labels).join(labels, "doc_id", "left").collect()
    assert len(got) == 609 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["toxic"] is not None]
    right = sum(r["predicted"] == r["toxic"] for r in held) / len(held)
    assert len(held) > 80 and right > 0.95
    assert toxicity.toxicity(docs.limit(3), labels.limit(0)).agg(F.max("score")).first()[0] == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_models_do_not_depend_on_the_layout(spark, labelled):
    """The same rows in other partitions and another order, and clashing labels of one id, give the same scores to the last bit."""
    docs, labels = labelled
    again = docs.orderBy(F.xxhash64("doc_id")).repartition(5), labels.union(labels.where("doc_id < 30").withColumn("toxic", F.lit(1))).repartition(3)
    first = docs.coalesce(1), labels.union(labels.where("doc_id < 30").withColumn("toxic", F.lit(1))).coalesce(1)
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.toxicity(*x).collect()} for x in (first, again))
    assert a == b
    a, b = ({r["doc_id"]: r["expected_grade"] for r in quality_model.graded(d, quality_model.ratings(n)).collect()} for d, n in (first, again))
    assert a == b


def test_features_of_a_batch_are_those_of_each_text(prose):
    texts = [prose(k, 30 + k) for k in range(20)] + ["", " ", "één ÉÉN één!", "*** ???", "a " * 500, "x" * 10_000]
    f = hashed_text.Features(texts)
    for text, at in zip(texts, f.rows()):
        one = hashed_text.Features([text]).rows()[0]
        assert sorted(at) == sorted(one)
        terms = toxicity.document_terms(text)
        assert abs(len(at) - len(terms - {""})) <= 0.02 * len(terms) + 8  # beginnings are of bytes here, of letters there
    rows = quality_model.features(texts)
    weights = np.random.default_rng(1).normal(size=hashed_text.DIM)
    assert np.allclose(quality_model._Counted(texts).margins(weights), [weights[at] @ x for at, x in rows])


def test_cumulative_link_slopes_are_those_of_the_likelihood():
    rng = np.random.default_rng(4)
    for _ in range(50):
        cuts, margin, target = np.sort(rng.normal(size=3)) + [0, 0.1, 0.2], rng.normal(), rng.dirichlet(np.ones(4))

        def loss(m, c):
            s = np.concatenate([[1], 1 / (1 + np.exp(-(m - c))), [0]])
            return -(target * np.log(s[:-1] - s[1:])).sum()

        by_margin, by_cut = linear.Ordinal(4, cuts=cuts).slopes(margin, target)
        e = 1e-6
        assert abs(by_margin - (loss(margin + e, cuts) - loss(margin - e, cuts)) / (2 * e)) < 1e-5
        for j in range(3):
            d = np.eye(3)[j] * e
            assert abs(by_cut[j] - (loss(margin, cuts + d) - loss(margin, cuts - d)) / (2 * e)) < 1e-5


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    fires = [np.where(y, rng.random(4000) < a, rng.random(4000) < b) for a, b in ((0.8, 0.02), (0.6, 0.05), (0.7, 0.03), (0.1, 0.1))]
    fires.append(fires[0])  # says again what the first says
    votes = np.array(fires + [np.zeros(4000)] * 6, float).T
    m = toxicity.LabelModel(votes, y.mean())
    p = m.posterior(votes)
    assert ((p > 0.5) == y).mean() > 0.93
    assert abs(m.rates[1][0] - 0.8) < 0.15 and m.rates[0][0] < 0.08
    assert m.correlations[0][4] > 0.9 and m.share[0] < 0.7 < m.share[1]


def test_ordinal_thresholds_are_ordered_and_grades_are_learned(spark, labelled):
    docs, labels = labelled
    rated = quality_model.ratings(labels)
    out = quality_model.graded(docs, rated).join(rated, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert all(1 >= r["p_ge_1"] >= r["p_ge_2"] >= 0 and abs(r["expected_grade"] - r["p_ge_1"] - r["p_ge_2"]) < 1e-12 for r in out)
    junk, fine = [r for r in out if r["grade"] == 0], [r for r in out if r["grade"] == 2]
    assert sum(r["kept"] for r in junk) <= 0.1 * len(junk) and sum(r["kept"] for r in fine) >= 0.95 * len(fine)
    assert sum(r["expected_grade"] for r in junk) / len(junk) < 0.5 < 1.5 < sum(r["expected_grade"] for r in fine) / len(fine)


def test_ordinal_edges(spark, edges):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_model.graded(edges.withColumnRenamed("lang", "kept"), quality_model.ratings(empty)).collect()
    assert len(out) == 9 and len({r["expected_grade"] for r in out}) == 1
    assert quality_model.graded(edges.limit(0), quality_model.ratings(empty)).count() == 0
    m = linear.Ordinal(3)
    assert list(m.cuts) == sorted(m.cuts) and m.tails(np.zeros(2)).shape == (2, 2)


def lm_brute_force(rows, target):
    """(n_tokens, target_ce, background_ce) of every row, counts without its own."""
    texts = [(t or "").lower().split() for _, t in rows]
    size = len({w for t in texts for w in t})
    pairs, before = ([Counter(), Counter()] for _ in range(2))
    for (k, _), t in zip(rows, texts):
        m = k in target and k is not None
        pairs[m].update(zip([None, *t], t)), before[m].update([None, *t[:-1]] if t else [])
    out = []
    for (k, _), t in zip(rows, texts):
        own, own_before = Counter(zip([None, *t], t)), Counter([None, *t[:-1]] if t else [])
        ce = []
        for m in (True, False):
            mine = (k in target and k is not None) == m
            lean = lm_score.LEAN
            ce.append(-sum(math.log((pairs[m][a, b] - mine * own[a, b] + lean / size) / (before[m][a] - mine * own_before[a] + lean)) for a, b in zip([None, *t], t)) / max(len(t), 1))
        out.append((len(t), *ce))
    return out


@pytest.mark.parametrize("hot, stretch, bucket", [(100_000, 1_000_000, 1_000_000), (20, 200, 100)])
def test_lm_scores_equal_brute_force(spark, make, prose, monkeypatch, hot, stretch, bucket):
    """With everything hot in one stretch, and with many stretches and buckets."""
    for name, value in (("HOT", hot), ("STRETCH", stretch), ("BUCKET", bucket)):
        monkeypatch.setattr(lm_score, name, value)
    rows = [(k, prose(k, 40)) for k in range(30)] + [(40, None), (41, ""), (42, "Unseen"), (None, "the an"), (7, "the an er"), (50, prose(3, 40)), (50, prose(3, 40)), (51, "w " * 3000)]
    target = set(range(0, 30, 3))
    got = lm_score.cross_entropy_difference(make(rows), spark.createDataFrame([(k,) for k in target] + [(None,)], "doc_id long")).collect()
    want = lm_brute_force(rows, target)
    key = lambda k, n, a, b: (-1 if k is None else k, n, round(a, 5), round(b, 5))
    assert sorted(key(r["doc_id"], r["n_tokens"], r["target_ce"], r["background_ce"]) for r in got) == sorted(key(k, *w) for (k, _), w in zip(rows, want))
    assert all(abs(r["score"] - (r["target_ce"] - r["background_ce"])) < 1e-12 for r in got)


def test_lm_scores_count_every_word_and_pair(spark, make):
    """More words and pairs than are hot; copies know each other, and another layout gives the same scores."""
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randrange(90_000)}" for _ in range(4000))) for k in range(40)]
    rows.append((50, rows[7][1]))
    docs, target = make(rows), spark.createDataFrame([(k,) for k in range(0, 40, 4)], "doc_id long")
    got = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(docs, target).collect()}
    want = lm_brute_force(rows, set(range(0, 40, 4)))
    # losses are sums of gains rounded to 2 ** -24
    assert all(abs(got[k]["target_ce"] - a) < 1e-6 and abs(got[k]["background_ce"] - b) < 1e-6 for (k, _), (_, a, b) in zip(rows, want))
    again = {r["doc_id"]: r["score"] for r in lm_score.cross_entropy_difference(docs.repartition(7), target).collect()}
    assert again == {k: r["score"] for k, r in got.items()}
    alone = [r["score"] for k, r in got.items() if k not in (7, 50)]
    assert min(got[7]["score"], got[50]["score"]) > max(alone) + 1
    assert lm_score.cross_entropy_difference(docs.limit(0), target).count() == 0
    assert lm_score.cross_entropy_difference(docs, target.limit(0)).count() == len(rows)


def test_lm_edges(spark, edges):
    got = lm_score.cross_entropy_difference(edges.withColumnRenamed("lang", "target"), spark.createDataFrame([(7,)], "doc_id long")).collect()
    assert len(got) == 9 and sum(r["n_tokens"] for r in got) == 50_000 + 14


def test_licenses(spark, edges, make, prose):
    name = "Licensed under the Apache License, Version 2.0."
    rows = [(1, prose(1, 50) + "\n" + name), (2, "Licensed under CC BY-NC 4.0."), (3, "released under the mit license"), (4, prose(2, 50)), (5, "A driving licence is needed to drive the large yellow car along this road today."), (6, None), (7, name + "\n" + name)]
    blocks = license_scan.license_blocks(make(rows)).collect()
    found = {(r["doc_id"], r["license"], len(r["differences"])) for r in blocks}
    assert found == {(1, "Apache-2.0", 0), (2, "CC-BY-NC-4.0", 0), (3, "MIT", 0), (7, "Apache-2.0", 0)}
    assert all(rows[r["doc_id"] - 1][1][r["begin"] : r["end"]].lower().startswith(("licensed", "released")) for r in blocks)
    assert {r["doc_id"]: r["n_blocks"] for r in license_scan.licensed_documents(make(rows)).collect()} == {1: 1, 2: 1, 3: 1, 7: 1}
    twice = license_scan.licensed_documents(make([(None, name), (None, "Licensed under CC BY 4.0."), (5, name), (5, "no mark")])).collect()
    assert sorted((r["doc_id"] or 0, r["license"]) for r in twice) == [(0, "Apache-2.0"), (0, "CC-BY-4.0"), (5, "Apache-2.0")]
    assert license_scan.license_blocks(edges.withColumnRenamed("lang", "license")).count() == 0
    assert license_scan.licensed_documents(edges.limit(0)).count() == 0


def test_every_template_is_found_as_itself(spark, make):
    """On one line, wrapped, in a quiet text, and behind other words; templates are a parameter."""
    t = license_scan.TEMPLATES
    names = sorted(t)
    rows = [(10 * k + j, x) for k, n in enumerate(names) for j, x in enumerate((t[n], "Some words.\n\n" + "\n".join(textwrap.wrap(t[n], 70)) + "\n\nand more", t[n].upper()))]
    got = {r["doc_id"]: r["license"] for r in license_scan.licensed_documents(make(rows)).collect()}
    assert got == {i: names[i // 10] for i, _ in rows}
    own = {"Own": "You may share this text with friends of the garden."}
    assert [r["license"] for r in license_scan.license_blocks(make([(1, "You may share this text, licensed, with friends of the garden.")]), templates=own).collect()] == ["Own"]


def test_wordings_that_decide_between_licenses():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    want = {
        "This work is licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0"], "licensed under the GNU Lesser General Public License, version 2.1": ["LGPL-2.1"],
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0"], "Licensed under CC BY 3.0.": ["CC-BY-3.0"], "Licensed under CC BY-ND 4.0.": ["CC-BY-ND-4.0"],
        "Licensed under CC BY-SA 2.0": [], "Licensed under the Apache License, Version 1.1.": [], "not released under the MIT License": [], "A driving licence is needed for this yellow car.": [],
        "One two three four five six seven eight nine ten eleven twelve. Released under the MIT License. Thirteen fourteen fifteen sixteen": ["MIT"],
        "This project is Licensed under the Apache License, Version 2.0 and you may use it freely": ["Apache-2.0"], "Copyright (c) 2019 Jane Doe. All rights reserved.": ["All-rights-reserved"],
        "Licensed under CC BY 4.0. Released under the MIT License.": ["CC-BY-4.0", "MIT"],
    }
    assert {x: [b[2] for b in license_scan.blocks_of(x, scanner)] for x in want} == want
    silent = (
        "Licensed under Creative Commons Attribution 2.0 Generic.", "This work is licensed under a Creative Commons Attribution 2.0 Generic License.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation.",
        "This project is no longer licensed under the Apache License, Version 2.0.", "It was never Released under the MIT License.", "Licensed under the Apache License, Version 2.0 no more.",
        "Distributed under the Boost Software License, Version 1.0.", "This work is licensed under terms that you may ask for.", "You may not use this file except in compliance with the License.",
        "under the terms of the GNU General Public License version 1", "Research under the MIT program of free software was fine.", "This software is provided as is, without warranty of any kind.",
        "Released under CC0 2.0 Universal.", "GNU General Public License",
    )
    assert {x: [b[2] for b in license_scan.blocks_of(x, scanner)] for x in silent} == dict.fromkeys(silent, [])
    # without the version as a template of its own, another one does not take its place
    fewer = license_scan.Scanner({k: v for k, v in license_scan.TEMPLATES.items() if k != "CC-BY-3.0"})
    assert license_scan.blocks_of("This work is licensed under CC BY 3.0.", fewer) == []
    assert [b[2] for b in license_scan.blocks_of("This work is licensed under CC BY 3.0.", scanner)] == ["CC-BY-3.0"]
    same = license_scan.Scanner({"b": "free to use by all people", "a": "free to use by all people"})
    assert license_scan.blocks_of("free to use by all people under warranty", same)[0][2] == "a"


def plain_scan(text, templates):
    """Every template against the whole text, word by word: the names whose own run of words stands there without a negation before it."""
    words = {n: [w.strip(".,;()\"<>") for w in t.lower().split()] for n, t in templates.items()}
    own = [w.strip(".,;()\"<>") for w in text.lower().split()]
    found = set()
    for n, w in words.items():
        for size in range(6, 12):
            for i in range(len(w) - size + 1):
                run = w[i : i + size]
                if any(run == o[k : k + size] for m, o in words.items() if m != n for k in range(len(o))):
                    continue
                if any(run == own[k : k + size] for k in range(len(own))):
                    found.add(n)
    return found


def test_scan_equals_a_plain_one_on_whole_notices(prose):
    """Texts with none, one or two notices between prose: the same licenses as by looking for any run of six words and more that one template alone has."""
    t, rng = license_scan.TEMPLATES, random.Random(4)
    # notices that differ in a name or version alone have no run of their own of that kind
    names = ["Apache-2.0", "BSD-3-Clause", "CC0-1.0", "ISC", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
    some = {n: t[n] for n in names}
    scanner = license_scan.Scanner(some)
    for k in range(40):
        picked = rng.sample(names, k % 3)
        text = "\n\n".join([prose(k, 30), *(x for n in picked for x in (some[n], prose(k + 100, 20)))])
        assert {b[2] for b in license_scan.blocks_of(text, scanner)} == set(picked) == plain_scan(text, some), (k, picked)


def test_java_filter_loses_no_mark(spark, make):
    rows = [(1, "all\u00a0rights\u00a0reserved, Copyright, all rights reserved."), (2, "LİCENCE"), (3, "cc\u00a0by 4.0"), (4, "as\u00a0is"), (5, "\u017foftware is free\u2003software"), (6, "nothing here")]
    kept = {r["doc_id"] for r in make(rows).where(F.col("text").rlike(license_scan._MAYBE)).collect()}
    assert {i for i, t in rows if license_scan._MARK.search(t)} <= kept and 6 not in kept
    assert [r["license"] for r in license_scan.license_blocks(make(rows[:1])).collect()] == ["All-rights-reserved"]
    long = "word " * 200_000 + "\n\nReleased under the MIT License.\n\n" + "word " * 1000
    found = license_scan.license_blocks(make([(1, long)])).collect()
    assert [(r["license"], long[r["begin"] : r["end"]].lower()) for r in found] == [("MIT", "released under the mit license")]


def test_sample_has_a_row_for_an_id_at_most(spark, make, prose):
    """Ids with many rows, texts beyond the bound, and null texts."""
    rows = [(k % 5, prose(k, 5)) for k in range(60)] + [(5, None), (6, "x " * linear.FIT_BYTES), (7, "one")]
    labels = spark.createDataFrame([(k, 1) for k in range(9)] + [(None, 1)], "doc_id long, toxic int")
    out = linear.labelled_sample(make(rows), labels, F.max("toxic"), 100, "sample").collect()
    assert sorted(r["doc_id"] for r in out) == [0, 1, 2, 3, 4, 5, 7] and {r["text"] for r in out if r["doc_id"] == 5} == {""}
    again = linear.labelled_sample(make(rows).repartition(5), labels, F.max("toxic"), 100, "sample").collect()
    assert {(r["doc_id"], r["text"]) for r in again} == {(r["doc_id"], r["text"]) for r in out}
    assert linear.labelled_sample(make(rows), labels, F.max("toxic"), 3, "sample").count() <= 3
