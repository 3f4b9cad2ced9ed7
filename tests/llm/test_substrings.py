import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from terraquarry.llm import common, substrings


def brute(texts, length):
    seen = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] += 1
    out = []
    for t in texts:
        cut = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cut[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~cut])
        out.append((len(t), int(cut.sum()), int(np.count_nonzero(np.diff(np.concatenate(([0], cut))) == 1)), hashlib.sha256(kept).hexdigest()))
    return out


def rows(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def planted(seed):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdeéßñ ", k=draw.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(draw.choices(words, k=n))
    base, passage, other = prose(300), prose(110), prose(95)
    texts = [base, base, base[:700] + "X" + base[700:], prose(50) + passage + prose(60), passage + prose(10), prose(80) + passage, prose(5) + passage[3:] + other + prose(3), other + passage + other]
    texts += [passage[:k] + prose(2) + passage[k:] for k in (150, 399, 400, 401, 450)]
    texts += ["ab" * 600, "x" * 900, "y" * 399, "y" * 399, "", None, "é" * 300, passage + passage[1:], prose(400), base[100:900] + passage[50:]]
    return texts


@pytest.mark.parametrize("block", [2000, 2, 1])
def test_planted_repeats_against_brute_force(spark, block):
    texts = planted(3)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, own int")
    want = sorted((i, *r) for i, r in enumerate(brute([(t or "").encode() for t in texts], 400)))
    assert rows(substrings.remove_repeats(docs, block=block)) == want


def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = sorted((r.doc_id, r.text) for r in docs.collect())
    want = sorted((i, *r) for (i, _), r in zip(found, brute([(t or "").encode() for _, t in found], 400), strict=True))
    assert rows(substrings.remove_repeats(docs)) == want


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "".join(random.Random(1).choices("abcdefgh ", k=900))
    docs = spark.createDataFrame([(None, text), (None, text), (1, "short"), (1, text[:500])], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in substrings.remove_repeats(docs).collect())
    assert got == [(-1, 900, 900), (-1, 900, 900), (1, 5, 0), (1, 500, 500)]
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_kept_text_round_trip(spark):
    text = "".join(random.Random(1).choices("abcdefgh ", k=900))
    docs = spark.createDataFrame([(1, "head " + text), (2, text + " tail")], "doc_id long, text string")
    assert {r.doc_id: bytes(r.kept) for r in substrings.remove_repeats(docs, keep_text=True).collect()} == {1: b"head ", 2: b" tail"}


def test_long_texts_are_searched_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 1000)
    monkeypatch.setattr(common, "CHUNK_BYTES", 500)
    import pyarrow as pa

    draw = random.Random(5)
    text = "".join(draw.choices("abcdefgh ", k=5000))
    batch = pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])
    total = 0
    for _, _, data, offsets, _ in substrings._segments([batch], 400):
        total += int(substrings.anchors(data, offsets, 400)[4].sum())
    assert total == 5000 - 399


@pytest.mark.parametrize("block", [2000, 7])
def test_a_passage_that_many_documents_share(spark, block):
    draw = random.Random(11)
    prose = lambda n: "".join(draw.choices("abcdefgh ", k=n))
    passage = prose(415)
    texts = [prose(draw.randint(0, 500)) + passage[draw.randint(0, 9) : 415 - draw.randint(0, 9)] + prose(draw.randint(0, 500)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((i, *r) for i, r in enumerate(brute([t.encode() for t in texts], 400)))
    assert rows(substrings.remove_repeats(docs, block=block)) == want


def test_groups_have_all_occurrences(spark):
    draw = random.Random(12)
    prose = lambda n: "".join(draw.choices("abcdefgh ", k=n))
    passage, whole = prose(450), prose(420)
    texts = [prose(50) + passage + prose(70), passage + prose(10), prose(33) + passage, prose(21) + passage[10:] + prose(9), whole, whole, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = defaultdict(set)
    for r in substrings.repeat_groups(docs).collect():
        text = (texts[r.doc_id] or "").encode()[r.start : r.start + r.n_bytes]
        groups[text].add((r.doc_id, r.start))
    assert groups and all(len(t) >= 400 for t in groups)
    for text, places in groups.items():
        assert places == {(i, k) for i, t in enumerate(texts) for k in range(len(t or "")) if (t or "").encode()[k:].startswith(text)}
    assert {i for places in groups.values() for i, _ in places} == {0, 1, 2, 3, 4, 5}


def test_intervals_of_an_lcp_array():
    assert sorted(substrings.intervals(np.array([0, 3, 5, 3, 0]))) == sorted([(5, 1, 2), (3, 0, 3), (0, 0, 4)])


def test_maximal_repeats_give_all_occurrences():
    strings = [(b"xab", b"cd1"), (b"yab", b"cd1"), (b"zab", b"cd2"), (b"zab", b"ce")]
    strings.sort(key=lambda s: s[1])
    import pyarrow as pa

    left, lengths = substrings.padded(pa.array([s[0][::-1] for s in strings], pa.binary()))
    right, rl = substrings.padded(pa.array([s[1] for s in strings], pa.binary()))
    groups = list(substrings.maximal_repeats(left, lengths, substrings.neighbours(right, rl)))
    best = defaultdict(int)
    for after, before, members in groups:
        for i in members:
            for j in members:
                if i < j:
                    best[i, j] = max(best[i, j], after + before)
    assert dict(best) == {(0, 1): 5, (0, 2): 4, (1, 2): 4, (0, 3): 3, (1, 3): 3, (2, 3): 4}


def test_repeats_of_399_400_and_401_bytes(spark):
    """A passage of under 400 bytes stays, however many words it has; of 400 or 401, every copy goes."""
    draw = random.Random(21)
    fill = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=500))
    for size in (399, 400, 401):
        passage = "".join(draw.choices("abcd ", k=size))
        texts = [fill() + "<" + passage + ">" + fill(), fill() + "{" + passage + "}" + fill(), fill()]
        got = rows(substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
        assert [r[2] for r in got] == ([0, 0, 0] if size < 400 else [size, size, 0])
        assert [r[3] for r in got] == [int(bool(r[2])) for r in got]
        assert [r[4] for r in got] == [hashlib.sha256((t if size < 400 else t.replace(passage, "")).encode()).hexdigest() for t in texts]
