"""Periodic runs of words: Kolpakov and Kucherov's algorithm, document by document.

A run is a stretch of words with smallest period q that no neighbouring word extends.
Words that any run could hold are found first: a run of at least ``min_length`` words
and ``exponent`` periods repeats a seed of min_length - min_length // exponent words at
a distance of q, and such seeds cover it whole. So the runs of a text are those of its
stretches covered by seeds that occur twice, and neither misses or adds one: a stretch
that ends where no repeated seed does cannot cut a run. On each stretch:

1. a suffix automaton gives the Lempel-Ziv factorisation with an earlier occurrence of
   each factor;
2. Main's algorithm finds the runs that touch or cross each border of factors, by four
   longest-extension tables over at most 2|previous| + |next| words to the left of it;
3. a run strictly inside a factor stands likewise inside the factor's earlier occurrence,
   and is copied from there.

Words are compared exactly (hashes serve the seeds alone, where equal ones by chance cost
time and nothing else). Everything is linear in the words of a document, up to the sort of
its seeds, and needs no shuffle: one map pass, in which no task holds more than one
document's words beside a batch (about 0.5 KB a word of the longest covered stretch).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquarry.llm import common

# ---------------------------------------------------------------- runs of one word sequence


def automaton(word: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """The suffix automaton of ``word``: transitions of each state, and where its strings first end."""
    go, link, length, first = [{}], [-1], [0], [-1]
    last = 0
    for at, letter in enumerate(word):
        here = len(go)
        go.append({})
        length.append(at + 1)
        first.append(at)
        link.append(0)
        state = last
        while state >= 0 and letter not in go[state]:
            go[state][letter] = here
            state = link[state]
        if state >= 0:
            to = go[state][letter]
            if length[to] > length[state] + 1:
                copy = len(go)
                go.append(go[to].copy())
                length.append(length[state] + 1)
                first.append(first[to])
                link.append(link[to])
                link[to] = copy
                while state >= 0 and go[state].get(letter) == to:
                    go[state][letter] = copy
                    state = link[state]
                to = copy
            link[here] = to
        last = here
    return go, first


def factors(word: list[int]) -> Iterator[tuple[int, int, int]]:
    """The Lempel-Ziv factorisation: start and end of each factor, and an earlier start of the same letters.

    A factor is the longest prefix of the rest that starts earlier too (it may reach into
    itself), or one new letter, whose earlier start is -1.
    """
    go, first = automaton(word)
    start, size = 0, len(word)
    while start < size:
        state, end, ended = 0, start, -1
        while end < size:
            state = go[state][word[end]]
            if first[state] >= end:
                break
            ended = first[state]
            end += 1
        if end == start:
            end, source = start + 1, -1
        else:
            source = ended - (end - start) + 1
        yield start, end, source
        start = end


def prefix_matches(word: list[int]) -> list[int]:
    """For each place, how many letters from there on equal the word's first ones (0 at the first place)."""
    size = len(word)
    out = [0] * size
    left = right = 0
    for i in range(1, size):
        k = min(out[i - left], right - i) if i < right else 0
        while i + k < size and word[k] == word[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        out[i] = k
    return out


def _at_border(word: list[int], low: int, border: int, high: int, min_length: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """Start, end and a period of the runs within [low, high) that touch or cross ``border`` (Main's algorithm)."""
    size = len(word)
    before, after = word[low:border], word[border:high]
    left, right = len(before), len(after)
    back = prefix_matches([*before[::-1], -1, *word[low:high][::-1]])  # letters are 0 and more
    forth = prefix_matches([*after, -1, *before, *after])
    for period in range(1, (left + right) // exponent + 1):
        least = max(min_length, exponent * period)
        if period <= left:  # a whole period lies before the border
            behind = back[period] if period < left else 0
            ahead = forth[right + 1 + left - period]
            if behind + ahead + period >= least:
                start, end = border - period - behind, border + ahead
                if (start == 0 or word[start - 1] != word[start - 1 + period]) and (end == size or word[end] != word[end - period]):
                    yield start, end, period
        if period <= right:  # or after it
            behind = back[left + 1 + right - period]
            ahead = forth[period] if period < right else 0
            if behind + ahead + period >= least:
                start, end = border - behind, border + period + ahead
                if (start == 0 or word[start - 1] != word[start - 1 + period]) and (end == size or word[end] != word[end - period]):
                    yield start, end, period


def runs(word: list[int], min_length: int = 24, exponent: int = 3) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of every run of a word of letters 0, 1, ...: at least ``min_length`` long and ``exponent`` (2 or more) periods.

    A run whose last letter lies in a factor and which starts before it reaches back by
    less than 2|previous factor| + |factor| (else the previous factor would be longer), so
    that these borders give it whole; one within a factor that touches its start or end
    is found at that border. Non-smallest periods of a run span the same letters, so the
    least of each span is kept.
    """
    if exponent < 2:
        raise ValueError("exponent must be 2 or more")
    size = len(word)
    found: dict[int, dict[int, int]] = {}  # start -> end -> period

    def at_border(previous: tuple[int, int], end: int) -> None:
        start, border = previous
        low = max(0, border - 2 * (border - start) - (end - border))
        if end - low >= min_length:
            for s, e, period in _at_border(word, low, border, end, min_length, exponent):
                own = found.setdefault(s, {})
                own[e] = min(period, own.get(e, period))

    previous = (0, 0)
    for start, end, source in factors(word):
        at_border(previous, end)
        if found and source >= 0 and end - start > min_length:
            shift, stop = start - source, source + end - start
            for at in range(start + 1, end):
                own = found.get(at - shift)
                if own:
                    for e, period in own.items():
                        if e < stop:
                            found.setdefault(at, {})[e + shift] = period
        previous = (start, end)
    at_border(previous, size)
    return sorted((s, e - s, period) for s, own in found.items() for e, period in own.items())


# ---------------------------------------------------------------- stretches that can hold runs


def _powers(count: int) -> np.ndarray:
    out = np.ones(count, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(1, count):
            out[i] = out[i - 1] * np.uint64(0xD6E8FEB86659FD93)
    return out


def covered(hashes: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """Which words lie in a sequence of ``seed`` words that occurs twice in its document; ``first`` has each document's first word."""
    total = len(hashes)
    inside = np.zeros(total, bool)
    if total < seed:
        return inside
    counts = np.diff(first)
    sums = np.zeros(total - seed + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j, power in enumerate(_powers(seed)):
            sums += hashes[j : j + len(sums)] * power
    document = np.repeat(np.arange(len(counts)), counts)
    document, whole = document[: len(sums)], np.flatnonzero(document[: len(sums)] == document[seed - 1 :])
    with np.errstate(over="ignore"):
        keys = common.mix(sums[whole] + document[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(total + 1, np.int64)
    steps[whole[twice]] += 1
    steps[whole[twice] + seed] -= 1
    return np.cumsum(steps[:-1]) > 0


def find(words: list[list[bytes]], min_length: int = 24, exponent: int = 3) -> list[list[tuple[int, int, int]]]:
    """The runs of each word list: start (word number), length, smallest period; by start, then period."""
    first = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    hashes = common.mix(np.fromiter((hash(w) for own in words for w in own), np.int64, int(first[-1])).view(np.uint64))
    starts, ends, of = common.spans(covered(hashes, first, min_length - min_length // exponent), first)
    out = []
    for at, own in enumerate(words):
        found = []
        for start, end in zip(starts[of[at] : of[at + 1]].tolist(), ends[of[at] : of[at + 1]].tolist(), strict=True):
            begin = start - int(first[at])
            letters: dict[bytes, int] = {}
            word = [letters.setdefault(w, len(letters)) for w in own[begin : end - int(first[at])]]
            found += [(begin + s, length, period) for s, length, period in runs(word, min_length, exponent)]
        out.append(sorted(found, key=lambda r: (r[0], r[2])))
    return out


def _kept(count: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words lie in no run after its first period."""
    steps = np.zeros(count + 1, np.int64)
    for start, length, period in found:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) == 0


def _strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for run in found:  # by start, then period: an equal one later does not replace an earlier one
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


# ---------------------------------------------------------------- the operator

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse(docs: DataFrame, *, min_length: int = 24, exponent: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every periodic run of each text, and the text without what the runs repeat.

    A row per document: doc_id, n_words, runs (array of start, length, period by start, then
    period; starts are word numbers from 0), strongest (the run of greatest exact length by
    period; ties: smallest start, then period; null without a run), text (the words that lie
    in no run after its first period, joined by one space). Words are
    ``[^\\x20\\x09-\\x0D]+``; a run has ``min_length`` words and ``exponent`` periods or more.

    A null, empty or blank text has no words, no runs and an empty result. Repeated rows and
    ids give a row each; a null id stays null. Other columns are ignored. An empty table gives
    no rows. Texts of any length are taken whole.
    """
    if exponent < 2 or min_length < exponent:
        raise ValueError("exponent must be 2 or more, min_length at least the exponent")
    common.tune(docs.sparkSession)
    docs = common.documents(docs, id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            words = [text.split() for text in batch.column("text").cast(pa.binary()).to_pylist()]  # bytes split at just these six characters
            found = find(words, min_length, exponent)
            texts = []
            for own, of in zip(words, found, strict=True):
                keep = own if not of else [own[i] for i in np.flatnonzero(_kept(len(own), of)).tolist()]
                texts.append(b" ".join(keep))
            as_struct = lambda r: None if r is None else dict(zip(("start", "length", "period"), r, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[as_struct(r) for r in of] for of in found], pa.list_(_RUN)),
                    pa.array([as_struct(_strongest(of)) for of in found], _RUN),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "strongest", "text"],
            )

    one = "struct<start: bigint, length: bigint, period: bigint>"
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<{one}>, strongest {one}, text string")


def digests(collapsed: DataFrame) -> DataFrame:
    """Of each row of ``collapse``: doc_id, n_runs, the strongest run, and digests of all runs and of the text."""
    line = lambda r: F.concat_ws(",", r.start, r.length, r.period)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = F.col("strongest")
    return collapsed.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.start.alias("start"),
        best.length.alias("length"),
        best.period.alias("period"),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of which about one in ten becomes periodic from some word on: doc_id and text alone.

    With h = crc32 of the decimal id and g = h // 10, where h % 10 is 0 and the text has n > 0
    words, each word i >= a becomes word a + (i - a) % p, a = g % n, p = 1 + (n - a) // (3 + g % 8).
    Rows with a null id stay as they are.
    """
    spread = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), spread.alias("h"), F.when(spread % 10 == 0, words).alias("words"))
    sized = split.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    # no lambda here: each slice is made once, however long the text
    placed = sized.withColumn("a", F.expr("CASE WHEN n > 0 THEN CAST(g % n AS INT) END")).withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    planted = F.expr("array_join(concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), CAST((n - a + p - 1) div p AS INT))), 1, n - a)), ' ')")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))

