import random
import re

import numpy as np
import pytest

from terraquarry.llm import neardup
from terraquarry.llm.components import connected_components


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = sorted((find(i), find(j)))
                    parent[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def rows(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("size", [4, 5])
def test_documents_against_brute_force(spark, sf, size):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute(sorted((r.doc_id, r.text) for r in docs.collect()), size, 80)
    assert rows(neardup.near_duplicates(docs, shingle=size)) == want


@pytest.mark.parametrize("options", [{}, {"node_limit": 16, "depth": 2}, {"node_limit": 16, "depth": 0}, {"node_limit": 16, "depth": 2, "few_limit": 4}, {"node_limit": 16, "depth": 0, "few_limit": 4}])
def test_a_crowd_of_near_copies_of_all_distances(spark, options):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = draw.choices(words, k=120)
    texts = []
    for i in range(220):
        own = list(base if i % 3 else texts[draw.randrange(len(texts))].split() if texts else base)
        for _ in range(draw.randint(0, 9)):
            own[draw.randrange(len(own))] = draw.choice(words)
        texts.append(" ".join(own))
    texts += [" ".join(draw.choices(words, k=60)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(neardup.near_duplicates(docs, shingle=4, **options)) == brute(list(enumerate(texts)), 4, 80)


def test_edge_cases(spark):
    texts = [(5, "A b"), (3, "a B"), (4, "a b c"), (9, None), (8, ""), (7, " \t\n"), (6, "é É"), (2, "é é"), (None, "a b"), (5, "A b")]
    docs = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id long, text string, n_shingles int, component_id int")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == {(5, 1, 3, False), (3, 1, 3, True), (4, 1, 4, True), (9, 0, 9, True), (8, 0, 8, True), (7, 0, 7, True), (6, 1, 6, True), (2, 1, 2, True), (None, 1, None, True)}
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 3, 4, 6, 7, 8, 9]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(0, text, 1), (2, text, 2), (2, "only here u v w x y z", 3), (1, "a b c d e f", 4), (1, "a b c d e f", 4), (1, "a b c d e f", 5), (None, text, 6), (None, text, 6), (7, None, 7), (7, "", 7)], "doc_id long, text string, _id int")
    kept = [(r.doc_id, r.text, r._id) for r in neardup.deduplicate(docs).collect()]
    assert sorted(kept, key=str) == sorted([(0, text, 1), (2, "only here u v w x y z", 3), (1, "a b c d e f", next(r[2] for r in kept if r[0] == 1)), (None, text, 6), (None, text, 6), (7, None, 7), (7, "", 7)], key=str)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs.where("doc_id IS NOT NULL")).collect())
    assert got == [(0, 0, True), *[(1, 1, True)] * 3, (2, 0, False), (2, 2, True), (7, 7, True), (7, 7, True)]


def test_words_that_a_polynomial_hash_confuses_are_not_linked(spark):
    word = "a"
    for _ in range(10):  # the Thue-Morse string and its complement
        word += word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(0, word), (1, word.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    assert [r.component_id for r in neardup.near_duplicates(docs).orderBy("doc_id").collect()] == [0, 1]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(i, 7) for i in range(200, 260)] + [(5, 5), (259, 258), (300, 299), (299, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]} | {299: 299, 300: 299}


def test_sketches_estimate_similarity():
    draw = np.random.default_rng(3)
    a = np.unique(draw.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.concatenate((a[:900], draw.integers(0, 2**63, 100).astype(np.uint64)))
    x, y = neardup.sketches(np.array([neardup.signature(a), neardup.signature(b)]))
    assert neardup.mismatches(x, y[None])[0] <= neardup.most_mismatches(0.8)
    assert neardup.mismatches(x, x[None])[0] == 0


@pytest.mark.parametrize("held", [4000])
def test_long_near_copies_are_resolved_in_slices(spark, held):
    """Texts of some 700 words under small limits of bytes: chains of copies, whose ends are far apart, and copies of one text."""
    draw = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    chain, texts = draw.choices(words, k=700), []
    for _ in range(25):  # each is near the last one, and less and less near the first
        at = draw.randrange(600)
        chain[at : at + 40] = draw.choices(words, k=40)
        texts.append(" ".join(chain))
    base = draw.choices(words, k=650)
    for _ in range(20):
        own = list(base)
        for _ in range(draw.randint(0, 12)):
            own[draw.randrange(650)] = draw.choice(words)
        texts.append(" ".join(own))
    texts += [" ".join(draw.choices(words, k=600)) for _ in range(4)]
    draw.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(neardup.near_duplicates(docs, shingle=4, held=held)) == brute(list(enumerate(texts)), 4, 80)


def test_a_large_node_is_dealt_in_parts(spark):
    """Every class in one node: its parts hold a few node limits each, and every member meets the node's pivots."""
    sketch = neardup.sketches(np.zeros((1, neardup.WIDTH), np.uint64))[0].tobytes()
    nodes = spark.createDataFrame([(5, i, sketch) for i in range(500)] + [(6, i, sketch) for i in range(3)], "node long, rep long, sketch binary")
    dealt, _ = neardup._parted(nodes, 120)
    parts = {}
    for r in dealt.collect():
        parts.setdefault((r.node, r.part), []).append((r.rep, r.own))
    assert len(parts) == 18 and max(len(p) for p in parts.values()) < 60 and sorted(parts[6, -1]) == [(0, True), (1, True), (2, True)]
    for (node, part), own in parts.items():
        assert node == 6 or sorted(r for r, mine in own if not mine) == list(range(neardup.PIVOTS))
    found = neardup._compare(nodes, 120, 10).collect()
    assert sorted((r.cluster, r.rep) for r in found if r.large) == [(5, i) for i in range(500)] and {r.pivot for r in found if r.large} == {0}
    assert sorted(r.rep for r in found if not r.large) == [0, 1, 2]
