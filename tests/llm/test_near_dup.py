import random

from assay.llm import near_dup


def brute_force(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(text, seed, n):
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(99)}"
    return " ".join(words)


def test_classes_equal_brute_force(spark, make, prose):
    rows = [(k, prose(k, 7 + 11 * k)) for k in range(20)]
    at = 100
    for base in range(4, 20):
        for n in range(6):
            rows.append((at, edited(rows[base][1], at, n)))
            at += 1
    # a group whose members differ more and more from the first, linked in a chain
    text = prose(77, 300)
    for k in range(12):
        text = edited(text, 500 + k, 4)
        rows.append((300 - k, text))
    rows += [(400, None), (401, ""), (402, "Two Words"), (403, "two words"), (404, "ÉA b c"), (405, "éa b c"), (406, "one")]
    rows += [(500 + k, rows[9][1]) for k in range(30)]
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(make(rows)).collect()}
    for i, (n, component) in brute_force(rows).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, component, i == component), i
    assert got[403]["component_id"] == 402 and got[405]["component_id"] == 405


def test_edges(spark, edges):
    out = near_dup.near_duplicates(edges.withColumnsRenamed({"lang": "rep", "source": "key"})).collect()
    assert len(out) == 9
    by = {r["doc_id"]: r for r in out}
    assert by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[8]["n_shingles"] == 1
    assert sum(r["doc_id"] == 7 and r["kept"] for r in out) == 2
    assert near_dup.near_duplicates(edges.limit(0)).count() == 0


def test_links_that_no_leader_sees(spark, make, prose, monkeypatch):
    """Families of texts around one centre, most of them under the threshold with each other, in small blocks and list by list."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rows = []
    for family in range(3):
        centre = prose(900 + family, 160)
        rows += [(1000 * family + k, edited(centre, 31 * family + k, 2 + k % 3)) for k in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(make(rows)).collect()}
    assert got == {i: component for i, (_, component) in brute_force(rows).items()}
    assert 20 < len(set(got.values())) < 180


def test_rows_that_share_an_id_keep_their_own_texts(spark, make, prose):
    a, b = prose(1, 80), prose(2, 80)
    rows = [(7, a), (7, b), (9, edited(b, 3, 1)), (None, a), (3, edited(a, 4, 1))]
    got = near_dup.near_duplicates(make(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["n_same"]) for r in got) == [(0, 3, 2), (3, 3, 1), (7, 3, 2), (7, 7, 1), (9, 7, 1)]


def test_a_pair_whose_differences_have_the_smallest_hashes(spark, make):
    """922 of 1078 shingles are shared (85.5 %), but nearly all of the smallest values of the union are not."""
    rng = random.Random(11)
    words = [f"w{k}x{rng.randrange(10**6)}" for k in range(1002)]
    pair = [list(words), list(words)]
    for side in pair:
        for k in range(26):
            at = 15 + 38 * k

            def least(word, at=at, side=side):
                return min(near_dup.shingle_set(" ".join([*side[at - 2 : at], word, *side[at + 1 : at + 3]]).encode()).tolist())

            if side is pair[1]:
                side[at] = min((f"y{rng.randrange(10**9)}" for _ in range(3000)), key=least)
            else:
                side[at] = min((f"x{rng.randrange(10**9)}" for _ in range(3000)), key=least)
    rows = [(1, " ".join(pair[0])), (2, " ".join(pair[1]))]
    sets = [near_dup.shingle_set(t.encode()) for _, t in rows]
    shared = set(sets[0].tolist()) & set(sets[1].tolist())
    low = sorted(set(sets[0].tolist()) | set(sets[1].tolist()))[:64]
    assert len(shared) == 922 and len(sets[0]) == 1000 and sum(h in shared for h in low) < 0.6 * 64
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_dup.near_duplicates(make(rows)).collect()}
    assert got == {1: (1, True), 2: (1, False)}
