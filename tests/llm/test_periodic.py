import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from terraquarry.llm import periodic, queries


def brute(word, min_length, exponent):
    """All runs by comparing the word with itself at every distance; the smallest period of a span comes first."""
    size, found = len(word), {}
    for period in range(1, size // exponent + 1):
        at = 0
        while at + period < size:
            if word[at] != word[at + period]:
                at += 1
                continue
            end = at
            while end + period < size and word[end] == word[end + period]:
                end += 1
            if end + period - at >= max(min_length, exponent * period):
                found.setdefault((at, end + period), period)
            at = end
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def words_of(text):
    return (text or "").encode().split()


def expected(doc_id, text):
    """The contract's row, computed the plain way."""
    words = words_of(text)
    size = len(words)
    spread = zlib.crc32(str(doc_id).encode())
    if spread % 10 == 0 and size:
        g = spread // 10
        a = g % size
        p = 1 + (size - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(size)]
    found = brute(words, 24, 3)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    strongest = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return doc_id, len(found), *strongest, digest("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone))


def random_word(draw):
    size, letters = draw.randint(0, 70), draw.choice([1, 2, 2, 3, 6])
    word = [draw.randrange(letters) for _ in range(size)]
    for _ in range(draw.randint(0, 2)):
        if size:
            a, p = draw.randrange(size), draw.randint(1, 12)
            end = draw.randint(a, size)
            word[a:end] = [word[a + (i - a) % p] if a + (i - a) % p < end else word[i] for i in range(a, end)]
    return word


def test_runs_against_brute_force():
    draw = random.Random(12)
    for _ in range(1500):
        word = random_word(draw)
        for least, exponent in ((1, 2), (5, 2), (6, 3), (24, 3), (9, 4)):
            want = sorted(brute(word, least, exponent))
            assert periodic.runs(word, least, exponent) == want, (word, least, exponent)
        texts = [[b"%d" % w for w in part] for part in (word, word[::-1], [], word[:7])]
        assert periodic.find(texts, 12, 3) == [brute(t, 12, 3) for t in texts]


def test_factors_are_the_longest_earlier_ones():
    draw = random.Random(3)
    for _ in range(300):
        word = random_word(draw)
        at = 0
        for start, end, source in periodic.factors(word):
            assert start == at < end
            longest = max((next((k for k in range(len(word) - start) if word[j + k] != word[start + k]), len(word) - start) for j in range(start)), default=0)
            assert end - start == max(longest, 1)
            assert (source < 0) == (longest == 0) and (source < 0 or word[source : source + end - start] == word[start:end] and source < start)
            at = end
        assert at == len(word)


def test_one_group_of_words_in_time():
    """Fibonacci words and one repeated word: many runs, long factors, a linear number of steps."""
    a, b = [0], [0, 1]
    while len(b) < 30_000:
        a, b = b, b + a
    assert len(periodic.runs(b, 2, 2)) < len(b)
    assert periodic.runs([0] * 30_000) == [(0, 30_000, 1)]


def test_query_over_whole_tables(spark, sf):
    found = {r.doc_id: tuple(r) for r in queries.op12_periodic(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        assert found[d.doc_id] == expected(d.doc_id, d.text), d.doc_id


def test_edge_cases(spark):
    line = "one two three four five\t\n"
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", "a " * 23, "a " * 24, "a b " * 12, "a b c d e f g h i " * 2, "a b c d e f g h i " * 3, line * 8, "é ü " * 30, "a\xa0b " * 30, "x\0y " * 30, "a" * 100_000, "a b a b a c " * 9 + "z " * 40]
    texts += [" ".join(random.Random(i).choices("abcdefgh", k=300)) + " x y z" * 20 for i in range(40)]
    docs = spark.createDataFrame([(i, t, 1, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string, words int, runs string")
    planted = periodic.with_planted_runs(docs)
    found = periodic.digests(periodic.collapse(planted)).collect()
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(repr(expected(i, t)) for i, t in enumerate(texts) for _ in range(2))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 1  # planted ones are among them
    assert periodic.collapse(docs.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "a b " * 20), (None, None)], "doc_id long, text string")
    rows = periodic.collapse(periodic.with_planted_runs(nameless)).orderBy("n_words").collect()
    assert [(r.doc_id, r.n_words, r.text, len(r.runs)) for r in rows] == [(None, 0, "", 0), (None, 40, "a b", 1)]
    with pytest.raises(ValueError):
        periodic.collapse(docs, exponent=1)


def test_long_text(spark):
    """A text of 300,000 words with a long period, in one piece."""
    draw = random.Random(5)
    head = [f"w{draw.randrange(2000)}" for _ in range(100_000)]
    text = " ".join(head + head[50_000:] * 4)
    (row,) = periodic.collapse(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(50_000, 250_000, 50_000)] and row.text == " ".join(head)
