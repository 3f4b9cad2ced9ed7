import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from terraquarry.llm import decontaminate, queries


def words_of(text):
    return re.findall(r"[A-Za-z0-9_\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def shingles(words, size=5):
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def brute(docs, items, threshold=0.8):
    """The best window of every item-sized stretch of shingles, by weighted Jaccard similarity."""
    out = {}
    own = {i: shingles(words_of(t)) for i, t in items}
    for doc, text in docs:
        every = shingles(words_of(text))
        for item, wanted in own.items():
            if not wanted or not every or not set(wanted) & set(every):
                continue
            size, want, best = min(len(wanted), len(every)), Counter(wanted), 0.0
            for at in range(len(every) - size + 1):
                shared = (Counter(every[at : at + size]) & want).total()
                best = max(best, shared / (size + len(wanted) - shared))
            if best >= threshold:
                out[doc, item] = best
    return out


def held(found, want):
    got = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_all_documents_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert want
    held(queries.op1_decontaminate(spark, sf), want)


def test_edited_items_and_edge_cases(spark):
    draw = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(1, 60)))) for i in range(30)] + [(30, None), (31, ""), (32, "only four words here")]
    docs = [(0, None), (1, ""), (2, "... --"), (3, "Only, FOUR words; here!"), (4, "only four words here and more")]
    for i in range(5, 120):
        own = items[draw.randrange(30)][1].split()
        for _ in range(draw.randint(0, 3)):
            own[draw.randrange(len(own))] = draw.choice(vocabulary)
        docs.append((i, " ".join([*draw.choices(vocabulary, k=draw.randint(0, 80)), *own, *draw.choices(vocabulary, k=draw.randint(0, 80))])))
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item_id int, similarity string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    held(decontaminate.contaminated(frame, bench), want)
    held(decontaminate.contaminated(frame, bench, block_items=4), want)  # in blocks
    kept = decontaminate.decontaminate(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _ in docs} - {d for d, _ in want})
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0


def test_multi_index_finds_all_within_the_radius_and_little_else():
    draw = np.random.default_rng(1)
    bits = draw.integers(0, 2, (300, decontaminate.BITS)).astype(np.uint8)
    pack = lambda x: np.packbits(x, axis=1).view(np.uint32)
    index = decontaminate.MultiIndex(pack(bits))
    assert sum(index.radii) == decontaminate.RADIUS - len(index.radii) + 1
    queries = bits[::10].copy()
    for q in queries:
        q[draw.choice(decontaminate.BITS, draw.integers(0, decontaminate.RADIUS + 1), replace=False)] ^= 1
    query, at = index.within(pack(queries))
    differ = (queries[:, None] != bits).sum(2)
    assert sorted(zip(query.tolist(), at.tolist(), strict=True)) == sorted(map(tuple, np.argwhere(differ <= decontaminate.RADIUS).tolist()))
    assert (query * 10 == at).sum() == len(queries)
    assert index.candidates(pack(draw.integers(0, 2, (200, decontaminate.BITS)).astype(np.uint8))).mean() < 0.03  # of unrelated ones


def test_windows_at_the_threshold_are_within_the_radius():
    draw = np.random.default_rng(2)
    for size in (9, 18, 45, 90):
        shared = -(-size * 8 // 9)  # the least at a similarity of 0.8
        differ = []
        for _ in range(400):
            own = draw.integers(0, 1 << 63, 2 * size).astype(np.uint64)
            a, b = own[:size], np.concatenate((own[:shared], own[size : 2 * size - shared]))
            x, y = (decontaminate.fingerprint(decontaminate.shingle_bits(s).sum(0, dtype=np.int64)[None], size) for s in (a, b))
            differ.append(int(np.bitwise_count(x ^ y).sum()))
        assert max(differ) <= decontaminate.RADIUS


def test_rows_that_share_an_id_and_ids_of_any_type(spark):
    item = " ".join(f"w{i}" for i in range(12))
    for kind, ids in (("int", [1, 1, None]), ("string", ["a", "a", None]), ("long", [1, 1, None])):
        docs = spark.createDataFrame(list(zip(ids, ["see " + item, "clean text here", "null " + item], strict=True)), f"doc_id {kind}, text string")
        bench = spark.createDataFrame([(ids[0], item), (ids[0], item), (None, item)], f"item_id {kind}, text string")
        got = decontaminate.contaminated(docs, bench).collect()
        assert sorted([(r.doc_id, r.item_id) for r in got], key=str) == sorted([(d, i) for d in (ids[0], None) for i in (ids[0], ids[0], None)], key=str)
        assert [r.text for r in decontaminate.decontaminate(docs, bench).collect()] == ["clean text here"]
        assert [r.text for r in decontaminate.decontaminate(docs, bench, block_items=1).collect()] == ["clean text here"]


def test_short_items_are_found_in_longer_documents(spark, tmp_path):
    items = [(0, "only four words here"), (1, "two words"), (2, "Only, four WORDS here"), (3, "one two three four five six"), (4, ""), (5, "lone")]
    docs = [(0, "only four words here and more"), (1, "in between only four words here"), (2, "only four words"), (3, "two other words, two words two words"), (4, None), (5, "only four words here"), (6, "so one two three four five six it is"), (7, "only four"), (8, "words here lonely"), (9, "lone")]
    spark.createDataFrame([(*d, "en") for d in docs], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_words) for r in queries.op1_decontaminate(spark, str(tmp_path)).collect()}
    four = {(d, i): (1.0, w, 4) for d, w in ((0, 0), (1, 2), (5, 0)) for i in (0, 2)}
    assert got == four | {(3, 1): (1.0, 3, 2), (6, 3): (1.0, 1, 6), (9, 5): (1.0, 0, 1)}
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.decontamination(spark, frame, str(tmp_path)).collect()) == [2, 4, 7, 8]
