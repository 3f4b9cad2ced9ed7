"""Exact repeats of long byte strings, by common-prefix interval trees.

A suffix array of a whole corpus fits no executor. Here it is partitioned by content: of
the 400-byte window at each byte, the ``GRAM``-byte string of least hash in it is its
anchor (the leftmost, where equal). Equal windows have equal anchors at equal places, so
windows repeat only among occurrences of one anchor string, and those form a partition of
the suffix array that all start alike.

1. One pass finds the anchors, each with the windows that it serves: about three rows for
   each 400 bytes. Anchor strings that occur once are dropped by a count.
2. Occurrences whose whole contexts (all bytes of the anchor's windows) are equal are one
   leaf of the interval tree, with a count: it repeats wherever the count is over one.
3. The differing contexts of an anchor string are sorted by what follows it: an enhanced
   suffix array with common-prefix lengths. A stack scan gives its interval tree. The
   members of each interval are sorted by what precedes the anchor, and the same scan gives
   the sets that differ to the left: each set that also differs to the right is a maximal
   repeat, with all its occurrences.
4. The array is scanned in blocks of bounded size. Most hold whole anchor strings; one of
   more contexts than a block is dealt by range, over as many tasks as it fills. A window can
   repeat beyond its block only as far as it agrees with the block's first or last row; the
   windows that do are matched between blocks by digests, one of each that the block's own
   tree has settled already.

Anchors are chosen and grouped by a rolling hash, which need not be free of collisions:
within a group, bytes are compared. Whole contexts are compared by 64-bit and windows at
block borders by 128-bit BLAKE2b digests.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquarry.llm import common

#: Bytes of an anchor string.
GRAM = 128
#: Rows of the suffix array that are scanned together.
BLOCK = 4000
_PLACE = 24
_PLACES = np.uint64((1 << _PLACE) - 1)
#: A longer text is searched in pieces of so many windows.
SEGMENT = 1 << 22


_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64)


@functools.lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    step, back = np.full(size, _BASE), np.full(size, _INVERSE)
    step[0] = back[0] = 1
    return np.multiply.accumulate(step), np.multiply.accumulate(back)


def rolling_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on."""
    power, back = _powers(1 << max(21, (len(data) + 1).bit_length()))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * power[: len(data)], out=prefix[1:])
    return common.mix((prefix[size:] - prefix[:-size]) * back[: len(data) - size + 1], 0x51ED270B)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts end to end: anchor hash, context hash, first window, anchor's place and windows of each anchor.

    Places are those in ``data``, of at most 2**24 bytes. Windows don't cross texts.
    """
    none = np.empty(0, np.int64)
    counts = np.maximum(0, np.diff(offsets) - length + 1)
    total = int(counts.sum())
    if not total:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    hashes = rolling_hashes(data, gram)
    places = np.arange(len(hashes))
    least = (hashes & ~_PLACES) | places.astype(np.uint64)  # equal hashes: the leftmost is least
    width, size = length - gram + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(data) - length + 1], least[width - size :][: len(data) - length + 1])
    windows = np.repeat(offsets[:-1] - np.cumsum(counts) + counts, counts) + np.arange(total)
    place = (least[windows] & _PLACES).astype(np.int64)
    edges = common.runs(place)
    first, number, at = windows[edges[:-1]], np.diff(edges), place[edges[:-1]]
    context = common.span_hashes(data, first, first + number - 1 + length) ^ common.mix((at - first).astype(np.uint64), 78)
    return hashes[at], common.mix(context), first, at, number


def _segments(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, their place in the batch, bytes, offsets, and where each piece starts in its text."""
    for batch in common.chunks(batches):
        data, offsets = common.text_buffers(batch.column("text"))
        if batch.num_rows > 1 or len(data) <= SEGMENT:
            yield batch, np.arange(batch.num_rows), data, offsets, np.zeros(batch.num_rows, np.int64)
            continue
        for at in range(0, len(data), SEGMENT):
            piece = data[at : at + SEGMENT + length - 1]
            yield batch, np.zeros(1, np.int64), piece, np.array([0, len(piece)]), np.array([at])


KEY = ["doc_id", "text_hash"]


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, data, offsets, base in _segments(batches, length):
            gram, context, first, at, number = anchors(data, offsets, length)
            of = np.searchsorted(offsets, first, "right") - 1
            keys = batch.select(KEY).take(pa.array(row[of]))
            shift = base[of] - offsets[of]
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(first + shift), pa.array(at - first, pa.int32()), pa.array(number, pa.int32())], names=[*KEY, "gram", "context", "start", "lead", "windows"])

    return docs.mapInArrow(run, f"{_key_schema(docs)}, gram long, context long, start long, lead int, windows int")


def _key_schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long"


def intervals(lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """The intervals of an lcp array by a stack scan: common length, first and last row.

    ``lcp[i]`` is what rows i - 1 and i have in common; ``lcp[0]`` is not read.
    """
    out, stack = [], []
    for i in range(1, len(lcp) + 1):
        value = int(lcp[i]) if i < len(lcp) else -1
        left = i - 1
        while stack and stack[-1][0] > value:
            common_, left = stack.pop()
            out.append((common_, left, i - 1))
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, left))
    return out


def neighbours(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many bytes each row has in common with the one above it; rows are padded to one width."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        out[1:] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    return out


def padded(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as rows of a matrix, and their lengths."""
    data, offsets = common.text_buffers(values)
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.uint8)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(data)) - np.repeat(offsets[:-1], lengths)] = data
    return out, lengths


def maximal_repeats(left: np.ndarray, left_lengths: np.ndarray, lcp: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Sets of rows sorted by what follows: how long they agree after and before, and their members.

    Every pair of rows is in a set with just what the two have in common.
    """
    for right, a, b in intervals(lcp):
        members = np.arange(a, b + 1)
        own = left[a : b + 1]
        order = np.lexsort(own.T[::-1]) if own.shape[1] else np.arange(len(own))
        before = neighbours(own[order], left_lengths[a : b + 1][order])
        # the child that each member is in: a set within one child is that child's own
        child = np.cumsum(np.concatenate(([0], lcp[a + 1 : b + 1] == right)))
        for length, i, j in intervals(before):
            among = order[i : j + 1]
            if len(among) == 2 or len(np.unique(child[among])) > 1:
                yield right, length, members[among]


def merged(rows: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges least to most of whole numbers, those of a row that overlap or adjoin as one."""
    order = np.lexsort((least, rows))
    rows, least, most = rows[order], least[order], most[order]
    base = rows.astype(np.int64) << 32  # keeps rows apart in one running maximum
    reach = np.maximum.accumulate(base + most)
    new = np.ones(len(rows), bool)
    new[1:] = (base + least)[1:] > reach[:-1] + 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    return rows[first], least[first], reach[last] - base[last] if len(rows) else most


def _blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Table, bool, bool]]:
    """Tables of whole anchor strings, or of a part of one; whether its first and its last string may go on elsewhere."""
    last = None
    for table, part in common.groups(batches, "gram", size):
        if last is not None:
            yield *last, last[0].column("gram")[-1].as_py() == table.column("gram")[0].as_py()
        last = table, last is None or part
    if last is not None:
        yield *last, True


def _digests(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in windows), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


FOUND = "first long, last long, w1 long, w2 long"


def _repeats(batches: Iterable[pa.RecordBatch], length: int, block: int, dealt: bool) -> Iterator[pa.RecordBatch]:
    """From rows sorted by anchor string and what follows it: repeated windows of contexts that occur once.

    Rows with a digest (w1, w2) are windows that may repeat in another block; those without a
    place (first is null) stand for windows that are settled in their own block. Such rows are
    given where anchor strings are ``dealt`` over blocks.
    """
    names = [*KEY, "first", "last", "w1", "w2"]
    for table, before, after in _blocks(batches, block):
        table = table.combine_chunks()
        right, right_lengths = padded(table.column("right").combine_chunks())
        left, left_lengths = padded(table.column("left").combine_chunks())
        lead, windows, times = (table.column(c).to_numpy() for c in ("lead", "windows", "times"))
        shared = neighbours(right, right_lengths)
        edges = common.runs(table.column("gram").to_numpy())
        shared[edges[:-1]] = 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # two contexts: one interval, without a scan
        pairs = edges[:-1][np.diff(edges) == 2]
        if len(pairs):
            differ = left[pairs] != left[pairs + 1] if left.shape[1] else np.zeros((len(pairs), 1), bool)
            agree = np.where(differ.any(1), differ.argmax(1), left.shape[1])
            agree = np.minimum(agree, np.minimum(left_lengths[pairs], left_lengths[pairs + 1]))
            rows = np.concatenate((pairs, pairs + 1))
            found.append((rows, np.tile(length - shared[pairs + 1], 2), np.tile(agree, 2)))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 2:
                for follow, precede, members in maximal_repeats(left[a:b], left_lengths[a:b], shared[a:b]):
                    if follow + precede >= length:
                        found.append((members + a, np.full(len(members), length - follow), np.full(len(members), precede)))
        none = np.empty(0, np.int64)
        rows, least, most = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)
        # a window starts so many bytes before its anchor
        least, most = np.maximum(least, lead[rows] - windows[rows] + 1), np.minimum(most, lead[rows])
        good = least <= most
        rows, least, most = merged(rows[good], least[good], most[good])
        own = times[rows] == 1
        yield _runs_of(table, names, rows[own], least[own], most[own], lead)
        open_ = [(0, int(edges[1]))] * before + [(int(edges[-2]), len(lead))] * after
        if dealt and open_:
            settled = rows, least, most
            yield from _border(table, names, length, sorted(set(open_)), before, after, (left, right, right_lengths, lead, windows, times), settled)


def _runs_of(table: pa.Table, names: list[str], rows: np.ndarray, least: np.ndarray, most: np.ndarray, lead: np.ndarray, digests: tuple | None = None) -> pa.RecordBatch:
    taken = table.select([*KEY, "start"]).take(pa.array(rows)).combine_chunks()
    place = taken.column("start").to_numpy() + lead[rows]
    none = pa.nulls(len(rows), pa.int64())
    return pa.RecordBatch.from_arrays([*(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in taken.select(KEY).columns), pa.array(place - most), pa.array(place - least), *(map(pa.array, digests) if digests else (none, none))], names=names)


def _border(table: pa.Table, names: list[str], length: int, open_: list[tuple[int, int]], before: bool, after: bool, parts: tuple, settled: tuple) -> Iterator[pa.RecordBatch]:
    """Digests of the windows of open anchor strings that agree with their block's first or last row throughout."""
    left, right, right_lengths, lead, windows, times = parts
    for a, b in open_:
        reach = np.zeros(b - a, np.int64)
        for row, side in ((a, before and a == 0), (b - 1, after and b == len(lead))):
            if side:
                differ = right[a:b] != right[row]
                agree = np.where(differ.any(1), differ.argmax(1), right.shape[1])
                reach = np.maximum(reach, np.minimum(agree, np.minimum(right_lengths[a:b], right_lengths[row])))
        rows, least, most = settled
        mine = (rows >= a) & (rows < b)
        rows, least, most = rows[mine] - a, least[mine], most[mine]
        first = np.searchsorted(rows, np.arange(b - a + 1))
        seen: set[bytes] = set()
        for at in range(a, b):
            low, high = max(length - int(reach[at - a]), int(lead[at] - windows[at]) + 1), int(lead[at])
            if low > high:
                continue
            context = left[at, : lead[at]][::-1].tobytes() + right[at].tobytes()
            done = np.zeros(high + 1, bool) if times[at] == 1 else np.ones(high + 1, bool)
            for k in range(first[at - a], first[at - a + 1]):
                done[least[k] : most[k] + 1] = True
            fresh, marks = [], []
            for back in range(low, high + 1):
                window = context[lead[at] - back : lead[at] - back + length]
                if not done[back]:
                    fresh.append((back, window))
                elif window not in seen:
                    seen.add(window)
                    marks.append(window)
            if fresh:
                back = np.array([f[0] for f in fresh])
                yield _runs_of(table, names, np.full(len(fresh), at), back, back, lead, _digests([f[1] for f in fresh]))
            if marks:
                batch = _runs_of(table, names, np.full(len(marks), at), np.zeros(len(marks), np.int64), np.zeros(len(marks), np.int64), lead, _digests(marks))
                yield batch.set_column(2, "first", pa.nulls(len(marks), pa.int64()))


def _same(a: DataFrame, b: DataFrame) -> Column:
    """The join condition on a document's key; ids may be null."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def _rows_of(batch: pa.RecordBatch) -> tuple[pa.StructArray, np.ndarray, np.ndarray, np.ndarray]:
    """The entries of the column ``own``, the row of each, and the batch's bytes and offsets."""
    own = batch.column("own")
    entries = own.flatten()
    row = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))
    return (entries, row, *common.text_buffers(batch.column("text")))


def _contexts(wanted: DataFrame, docs: DataFrame, length: int, reach: int | None = None) -> DataFrame:
    """What precedes (last byte first) and follows each wanted anchor, within its windows, or ``reach`` bytes of its text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            entries, row, data, offsets = _rows_of(batch)
            start, lead, windows = (entries.field(c).to_numpy() for c in ("start", "lead", "windows"))
            at = offsets[row] + start
            place, end = at + lead, at + windows - 1 + length
            if reach:
                at, end = np.maximum(place - reach, offsets[row]), np.minimum(place + reach, offsets[row + 1])
            left = [data[a:b][::-1].tobytes() for a, b in zip(at, place, strict=True)]
            right = [data[a:b].tobytes() for a, b in zip(place, end, strict=True)]
            keys = batch.select(KEY).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*keys.columns, *(entries.field(c) for c in ("gram", "context", "members", "start", "lead", "windows", "times")), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=[*KEY, "gram", "context", "members", "start", "lead", "windows", "times", "left", "right"])

    return _with_text(wanted, docs).mapInArrow(run, f"{_key_schema(docs)}, gram long, context long, members long, start long, lead int, windows int, times long, left binary, right binary")


def _with_text(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents with the wanted anchors of each, as one list; other texts are held back map-side."""
    near = common.likely(docs, F.xxhash64(*KEY), wanted.select(F.xxhash64(*KEY).alias("k")).distinct()).where("likely")
    own = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "context", "members", "start", "lead", "windows", "times")).alias("own")).hint("merge")
    return near.join(own, _same(near, own)).select(near["doc_id"], near["text_hash"], "text", "own")


def _leaves(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Occurrences of anchor strings that repeat, and their differing contexts with how often each occurs."""
    rows = common.materialize(_anchor_rows(docs, length), "anchors")
    grams = rows.groupBy("gram").agg(F.count("*").alias("n"), (F.min("context") != F.max("context")).alias("mixed")).where("n > 1").select("gram", "mixed")
    grams = common.materialize(grams, "grams")
    # with nothing but the two exchanges below it, Spark splits this join where an anchor string is hot
    again = common.materialize(rows.hint("merge").join(grams, "gram"), "repeated")
    common.drop(rows, grams)
    contexts = again.groupBy("gram", "context", "mixed").agg(F.count("*").alias("times"), F.min(F.struct(*KEY, "start", "lead", "windows")).alias("one"))
    return again, common.materialize(contexts.select("gram", "context", "mixed", "times", "one.*"), "contexts")


def _array(docs: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """The suffix array: differing contexts of anchor strings of which one occurs once, by anchor string and what follows."""
    some = contexts.where("mixed").groupBy("gram").agg(F.min("times").alias("least"), F.count("*").alias("members")).where("least = 1").select("gram", "members")
    some = common.materialize(some, "open")
    wanted = common.materialize(contexts.where("mixed").hint("merge").join(some, "gram"), "wanted")
    texts = common.materialize(_contexts(wanted, docs, length), "texts")
    common.drop(some, wanted)
    return texts


def repeated_windows(docs: DataFrame, length: int, block: int) -> DataFrame:
    """Runs of window starts whose bytes also start elsewhere: doc_id, text_hash, first, last; written to shared storage."""
    again, contexts = _leaves(docs, length)
    run = [*KEY, F.col("start").alias("first"), (F.col("start") + F.col("windows") - 1).alias("last")]
    leaves = contexts.where("mixed AND times > 1").select("gram", "context")
    several = again.where("mixed").hint("merge").join(leaves, ["gram", "context"]).select(*run)

    texts = _array(docs, contexts, length)
    schema = f"{_key_schema(docs)}, {FOUND}"
    whole = texts.where(F.col("members") <= block).repartition("gram").sortWithinPartitions("gram", "right")
    scanned = whole.mapInArrow(lambda b: _repeats(b, length, block, False), schema)
    large = texts.where(F.col("members") > block)
    if count := large.count():
        dealt = large.repartitionByRange(-(-count // block), "gram", "right").sortWithinPartitions("gram", "right")
        scanned = scanned.unionByName(dealt.mapInArrow(lambda b: _repeats(b, length, block, True), schema))
    scanned = common.materialize(scanned, "scanned")
    border = scanned.where("w1 IS NOT NULL")
    across = border.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    across = border.where("first IS NOT NULL").join(across, ["w1", "w2"]).select(*KEY, "first", "last")
    found = again.where("NOT mixed").select(*run).unionByName(several).unionByName(scanned.where("w1 IS NULL").select(*KEY, "first", "last")).unionByName(across)
    found = common.materialize(found, "found")
    common.drop(again, contexts, texts, scanned)
    return found


def repeat_groups(docs: DataFrame, *, length: int = 400, reach: int = 2000, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats of ``length`` bytes and more, with all their occurrences: repeat, n_bytes, doc_id, start (in bytes).

    ``repeat`` is a digest of the repeated bytes, so equal strings are one group wherever they
    were found. Repeats are followed for ``reach`` bytes to each side of an anchor: a longer one
    comes as overlapping ones. An anchor string that occurs more often than ``block`` times
    gives the repeats that occur twice within a block of its suffix array. Rows, nulls and
    other columns are treated as in ``remove_repeats``.
    """
    docs = _keyed(docs, length, id_col, text_col)
    again, contexts = _leaves(docs, length)
    common.drop(contexts)
    texts = common.materialize(_contexts(again.withColumns({"times": F.lit(1).cast("long"), "members": F.lit(0).cast("long")}), docs, length, reach), "texts")
    sorted_ = texts.repartition("gram").sortWithinPartitions("gram", "right")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in common.groups(batches, "gram", block):
            table = table.combine_chunks()
            right, right_lengths = padded(table.column("right").combine_chunks())
            left, left_lengths = padded(table.column("left").combine_chunks())
            shared, edges, out = neighbours(right, right_lengths), common.runs(table.column("gram").to_numpy()), []
            place = table.column("start").to_numpy() + table.column("lead").to_numpy()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for follow, precede, members in maximal_repeats(left[a:b], left_lengths[a:b], shared[a:b]):
                    if follow + precede >= length:
                        text = left[a + members[0], :precede][::-1].tobytes() + right[a + members[0], :follow].tobytes()
                        name = hashlib.blake2b(text, digest_size=16).hexdigest()
                        out += [(name, len(text), int(a + m), int(place[a + m]) - precede) for m in members]
            if out:
                name, size, at, start = zip(*out, strict=True)
                ids = table.column("doc_id").combine_chunks().take(pa.array(at))
                ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(size, pa.int64()), ids, pa.array(start, pa.int64())], names=["repeat", "n_bytes", "doc_id", "start"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return sorted_.mapInArrow(run, f"repeat string, n_bytes long, doc_id {kind}, start long").distinct()


def _keyed(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    common.tune(docs.sparkSession)
    return common.documents(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))


def remove_repeats(docs: DataFrame, *, length: int = 400, block: int = BLOCK, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts anywhere else.

    A row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 (of the remaining bytes, end to end), cut (whether anything was removed) and,
    with ``keep_text``, kept (binary: a cut may fall inside a character). Strings are judged on the input, overlaps count,
    matches don't cross documents.

    A null text counts as empty; texts shorter than ``length`` keep everything; rows that
    repeat count as documents of their own, and so cover each other; a null doc_id is an id
    like others; other columns are ignored; an empty table gives no rows. ``length`` must be
    at least twice the anchor's. ``block`` bounds the rows that a task sorts and scans at once.
    """
    docs = _keyed(docs, length, id_col, text_col)
    found = repeated_windows(docs, length, block)
    runs = found.groupBy(*KEY).agg(F.collect_list(F.struct("first", "last")).alias("own"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "cut", *["kept"] * keep_text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            data, offsets = common.text_buffers(batch.column("text"))
            own = batch.column("own")
            ends = own.offsets.to_numpy()
            first, last = (own.values.field(c).to_numpy() for c in ("first", "last"))
            removed, spans, digests, kept = [], [], [], []
            for at in range(batch.num_rows):
                text = data[offsets[at] : offsets[at + 1]]
                a, b = first[ends[at] : ends[at + 1]], last[ends[at] : ends[at + 1]] + length
                if own.is_valid()[at].as_py() and len(a):
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    cut = np.flatnonzero(a[1:] > b[:-1]) + 1
                    a, b = a[np.append(0, cut)], b[np.append(cut - 1, len(b) - 1)]
                    whole = b"".join(text[x:y].tobytes() for x, y in zip(np.append(0, b), np.append(a, len(text)), strict=True))
                else:
                    a, whole = a[:0], text.tobytes()
                removed.append(len(text) - len(whole))
                spans.append(len(a))
                digests.append(hashlib.sha256(whole).hexdigest())
                if keep_text:
                    kept.append(whole)
            columns = [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(np.array(removed) > 0)]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(kept, pa.binary())] * keep_text], names=names)

    marked = common.likely(docs, F.xxhash64(*KEY), found.select(F.xxhash64(*KEY).alias("k")).distinct())
    near = marked.where("likely")
    joined = near.hint("merge").join(runs, _same(near, runs), "left").select(near["doc_id"], "text", "own")
    rest = marked.where("NOT likely").select("doc_id", "text", F.lit(None).cast(runs.schema["own"].dataType).alias("own"))
    return rest.unionByName(joined).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, cut boolean" + ", kept binary" * keep_text)
