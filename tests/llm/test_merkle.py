import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from terraquarry.llm import merkle


def edited(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        out[i] = (t, t[: len(t) - len(t) // 2] + nxt[: len(t) // 2], nxt)
    return out


def test_documents_against_the_definition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = edited([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r for r in merkle.compare_edited(docs).collect()}
    assert got.keys() == want.keys()
    by_text = {}
    for i, (text, new, _) in want.items():
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        for t, f in ((text, r.fingerprint), (new, r.edited_fingerprint)):
            assert by_text.setdefault(t, f) == f
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(set(by_text.values())) == len(by_text)
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.9 * len(got)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def in_phrases(paragraph):
    """Eight words at most, the last of a sentence its phrase's last; white space goes with the word before, or the first one after."""
    words, out, own = re.findall(r"^\s*\S+\s*|\S+\s*", paragraph, re.ASCII), [], []
    for w in words:
        own.append(w)
        if len(own) == 8 or w.strip(" \t\n\r\f\v")[-1] in ".!?":
            out.append("".join(own))
            own = []
    return out + ["".join(own)] * bool(own)


def tree(text):
    """The written tree, and its phrases' hashes with their lengths."""
    sections, leaves = [], set()
    for section in re.findall(r"(?:[^\n]|\n(?!\n))*(?:\n{2,}|\Z)", text):
        paragraphs = []
        for p in re.findall(r"[^\n]*\n+|[^\n]+\Z", section):
            own = [(sha(x)[:12], min(len(x), 65535)) for x in in_phrases(p)]
            leaves.update(own)
            paragraphs.append((sha(p), ".".join(f"{h}{n:04x}" for h, n in own)))
        if section:
            sections.append((sha("".join(h for h, _ in paragraphs)), ",".join(f"{h[:16]}-{x}" for h, x in paragraphs)))
    root = sha("".join(h for h, _ in sections))
    return root, root + ":" + ";".join(f"{h[:16]}={x}" for h, x in sections), leaves


def alike(a, b):
    (root, _, x), (other, _, y) = tree(a), tree(b)
    total = sum(n for _, n in x) + sum(n for _, n in y)
    return 1.0 if root == other else 2 * sum(n for _, n in x & y) / total if total else 0.0


def test_fingerprints_and_likeness_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = ["", "a", "a\n\n\n b. c d\n", "\n\n", "  x  ", "x\n \ny", "one two three four five six seven eight nine ten! é😀 x", "x" * 70_000 + " y"]
    docs = docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    want = edited([(r.doc_id, r.text) for r in docs.collect()])
    for r in merkle.compare_edited(docs).collect():
        text, new, after = want[r.doc_id]
        assert (r.fingerprint, r.edited_fingerprint) == (tree(text)[1], tree(new)[1])
        assert abs(r.near_edited - alike(text, new)) < 1e-12 and abs(r.near_next - alike(text, after)) < 1e-12


def test_edge_cases(spark):
    rows = [(1, None), (2, "one"), (2, "one"), (3, "a\n\nb\r\n é"), (4, ""), (7, "x" * 70_000 + " y")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, part int")
    want = edited(sorted(set(rows), key=lambda r: r[0]))
    got = merkle.compare_edited(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.edited_sha256 == hashlib.sha256(want[r.doc_id][1].encode()).hexdigest()
    one = merkle.compare_edited(docs.where("doc_id = 3")).collect()[0]
    assert one.near_next == 1.0
    null = merkle.compare_edited(spark.createDataFrame([(None, "abcd"), (1, "xy")], "doc_id long, text string")).where("doc_id IS NULL").collect()[0]
    assert null.edited_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert merkle.compare_edited(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "a", "a\nb", "a\n\n\n b. c d\n", "\n\n", "  x  ", "x\n \ny"])
def test_pieces_join_up_to_the_text(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(
        F.array_join(F.flatten(F.transform(F.split("t", merkle._SECTION), lambda s: F.split(s, merkle._PARAGRAPH))), "").alias("paragraphs"),
        F.array_join(F.regexp_extract_all("t", F.lit(merkle._PHRASE), F.lit(0)), "").alias("phrases"),
    ).collect()[0]
    assert row.paragraphs == text
    assert row.phrases == (text if text.strip() else "")


def test_differing_branches_locate_edits(spark):
    df = spark.createDataFrame([("a b\nc d\n\ne f\ng h", "a b\nc d\n\ne X\ng h")], "x string, y string")
    r = df.select(merkle.changed_branches(merkle.fingerprint(F.col("x")), merkle.fingerprint(F.col("y"))).alias("c")).collect()[0]
    assert r.c == [2]


def test_blanks_take_linear_time(spark):
    """A paragraph of a million blanks has no phrase, and is not searched anew from each of them."""
    texts = [" " * 1_000_000, "a" + " " * 500_000 + "b" + "\t" * 300_000, "." * 300_000, "x. " * 100_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    start = time.monotonic()
    found = {r.doc_id: r.f for r in docs.select("doc_id", merkle.fingerprint(F.col("text")).alias("f")).collect()}
    assert time.monotonic() - start < 30
    assert found[0].endswith("-") and found[1].count(".") == 0 and found[3].count(".") == 99_999


def test_phrases_are_those_of_the_pattern_with_retries(spark):
    draw = random.Random(9)
    plain = re.compile(r"\s*(?:\S*[^\s.!?]\s+){0,7}\S+\s*", re.ASCII)
    texts = ["".join(draw.choices("ab.!? \t", (4, 4, 2, 1, 1, 6, 1), k=draw.randint(0, 120))) for _ in range(300)] + ["   ", " a", "a ", ". .. ..."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.p for r in docs.select("doc_id", F.regexp_extract_all("text", F.lit(merkle._PHRASE), F.lit(0)).alias("p")).collect()}
    assert all(found[i] == plain.findall(t) for i, t in enumerate(texts))
