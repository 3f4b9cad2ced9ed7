"""What the operators of this subpackage share: shared storage, Arrow batches, byte hashes.

Texts reach Python as Arrow buffers. The hashes below work on those buffers with
NumPy, so that no Python object is made per word. All seeds are fixed: every
executor, retry and session gives equal hashes.
"""

from __future__ import annotations

import atexit
import bisect
import contextlib
import functools
import hashlib
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one NumPy pass covers; a longer document is a pass of its own.
CHUNK_BYTES = 1 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, so that long texts fit in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="terraquarry-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the one given to setCheckpointDir.

    A session that names none gets a folder of its own on a local master (as in tests); on
    any other master that is an error, since executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if re.fullmatch(r"local(\[.*\])?", context.master):
        return f"file://{_own_dir()}"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


_FOLDERS: set[str] = set()


def _folder(spark: SparkSession) -> str:
    """This application's own folder of intermediate tables; it goes when the driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/terraquarry/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # what can't be deleted, or no longer, stays
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back: lineage ends there, and no executor holds the only copy."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete materialized tables that nothing reads any more."""
    for table in tables:
        if table is not None and hasattr(table, "_written_at"):
            _delete(table.sparkSession, table._written_at)


#: Bits of the largest filter that ``likely`` makes: 16 MB.
FILTER_BITS = 1 << 27


def likely(df: DataFrame, key: Column, keys: DataFrame, name: str = "likely") -> DataFrame:
    """``df`` with a boolean column: False only where ``key`` (a 64-bit hash) is not among those of ``keys``.

    ``keys`` has one long column. It becomes a bitmap of 16 bits a key and ``FILTER_BITS`` at
    most, however many keys there are; with more keys, more rows are True by chance, and
    none is False wrongly. What is broadcast is the bitmap's words, in one map-side join.
    """
    (column,) = keys.columns
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(10, (16 * keys.count()).bit_length()))
    place = lambda c: F.pmod(c, F.lit(bits))
    at = keys.select(place(F.col(column)).alias("p"))
    one = F.lit(1).cast("long")
    words = at.groupBy(F.shiftright("p", 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", one, F.pmod(F.col("p"), F.lit(64)).cast("int"))).alias("_bits"))
    marked = df.withColumn("_place", place(key)).withColumn("_at", F.shiftright("_place", 6))
    found = marked.join(F.broadcast(words), F.col("_at") == F.col("_word"), "left")
    bit = F.call_function("shiftright", F.col("_bits"), F.pmod(F.col("_place"), F.lit(64)).cast("int")).bitwiseAND(one) == 1
    return found.withColumn(name, F.coalesce(bit, F.lit(False))).drop("_place", "_at", "_word", "_bits")


def sampled_texts(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of the distinct texts, chosen by hash, in one partition: the same ones in any session.

    ``docs`` is as ``documents`` returns it. Equal rows count once, so that copies cannot fill the sample.
    """
    scale = 1 << 30
    total = docs.count()
    least = scale if total <= rows else -(-scale * rows // total)
    hashed = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").where(F.pmod("h", F.lit(scale)) < least)
    return hashed.groupBy("h").agg(F.any_value("text").alias("text")).coalesce(1).sortWithinPartitions("h").select("text")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the whole text (null: empty) alone, so that no other column's name can clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and where each value starts (one more at the end)."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or not len(offsets):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def groups(batches: Iterable[pa.RecordBatch], key: str, limit: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole groups from batches sorted by an integer ``key``; a group may span batches.

    With ``limit``, a group of more rows than that comes in parts, as they arrive, each
    alone in its table and marked True: it is never held whole.
    """
    held: list[pa.RecordBatch] = []
    large = None  # the key of a group that is being passed on in parts
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if large is not None:
            same = int(np.searchsorted(keys, large, "right"))
            if same:
                yield pa.Table.from_batches([batch.slice(0, same)]), True
            batch, keys = batch.slice(same), keys[same:]
            if not len(keys):
                continue
            large = None
        last = int(np.searchsorted(keys, keys[-1], "left"))  # where the open group starts
        if held and last == 0 and held[0].column(key)[0].as_py() == keys[-1]:
            held.append(batch)
        else:
            done = [*held, batch.slice(0, last)] if last else held
            if done:
                yield from _parted(pa.Table.from_batches(done), key, limit)
            held = [batch.slice(last)]
        if limit is not None and sum(b.num_rows for b in held) > limit:
            large = keys[-1]
            yield pa.Table.from_batches(held), True
            held = []
    if held:
        yield from _parted(pa.Table.from_batches(held), key, limit)


def _parted(table: pa.Table, key: str, limit: int | None) -> Iterator[tuple[pa.Table, bool]]:
    """Groups over the limit apart from the others."""
    edges = runs(table.column(key).to_numpy())
    at = 0
    for i in np.flatnonzero(np.diff(edges) > limit) if limit is not None else ():
        if edges[i] > at:
            yield table.slice(at, edges[i] - at), False
        yield table.slice(edges[i], edges[i + 1] - edges[i]), True
        at = edges[i + 1]
    if at < table.num_rows:
        yield table.slice(at), False


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours start, and the length at the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))


# ---------------------------------------------------------------- hashes of bytes


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(salt & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: The lowest k bytes of a 64-bit value.
_LOW = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)
#: Longer spans are hashed by BLAKE2b, one at a time.
LONG = 256
#: Spans that one pass hashes.
_PASS = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (zeros after the end) as 64-bit values, of a copy of the data."""
    wide = np.zeros(len(data) + 8, np.uint8)
    wide[: len(data)] = data
    return np.ndarray(len(data) + 1, np.dtype("<u8"), wide, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever they stand; with ``fold``, A-Z as a-z.

    Bytes go in by eights, each through a bijection: spans of at most eight bytes and of one
    length have different hashes if they differ, and longer ones by chance alone (no
    structure of the text cancels out, as it does in polynomials modulo a power of two).
    """
    data = _LOWER[data] if fold else data
    eights = windows(data)
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), _PASS):
        _hash_pass(data, eights, starts[at : at + _PASS], ends[at : at + _PASS], out[at : at + _PASS])
    return out


def _hash_pass(data: np.ndarray, eights: np.ndarray, starts: np.ndarray, ends: np.ndarray, out: np.ndarray) -> None:
    lengths = ends - starts
    out[:] = mix(lengths.astype(np.uint64), 0x51ED270B)
    rows, at, left = np.arange(len(starts)), starts, lengths
    long = np.flatnonzero(lengths > LONG)
    if len(long):
        short = np.flatnonzero(lengths <= LONG)
        rows, at, left = short, starts[short], lengths[short]
        for i in long.tolist():
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    while len(rows):
        out[rows] = mix(out[rows] ^ (eights[at] & _LOW[np.minimum(left, 8)]))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8


def equal_spans(one: np.ndarray, starts: np.ndarray, other: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether spans of two texts (as ``windows`` gives them) have the same bytes: starts, places and one length each."""
    same = np.ones(len(starts), bool)
    rows, a, b, left = np.arange(len(starts)), starts, places, lengths
    while len(rows):
        low = _LOW[np.minimum(left, 8)]
        good = (one[a] & low) == (other[b] & low)
        same[rows[~good]] = False
        more = good & (left > 8)
        rows, a, b, left = rows[more], a[more] + 8, b[more] + 8, left[more] - 8
    return same


def overlap_test(intervals: Iterable[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a span shares a place with any of the intervals (start, end), by one search: the furthest end of all that start before its end decides."""
    ordered = sorted(intervals)
    starts, furthest = [a for a, _ in ordered], list(itertools.accumulate((b for _, b in ordered), max))

    def touches(start: int, end: int) -> bool:
        before = bisect.bisect_left(starts, end)
        return before > 0 and furthest[before - 1] > start

    return touches


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True that don't cross values: starts, ends, and the first run of each value (one more at the end)."""
    size = len(inside)
    if not size:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


#: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Letters and digits of ASCII, "_", and all bytes of other characters.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


#: Bytes in which words are looked for at once.
PIECE = 1 << 24


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as runs of bytes of a kind: starts, ends, and the first word of each value; the bytes are taken piece by piece."""
    size, first, last = len(data), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, size, PIECE):
        end = min(size, at + PIECE)
        inside = kind[data[at:end]]
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[1:], before[0] = inside[:-1], at > 0 and kind[data[at - 1]]
        after[:-1], after[-1] = inside[1:], end < size and kind[data[end]]
        before[offsets[(offsets >= at) & (offsets < end)] - at] = False  # no word reaches into the next value
        after[offsets[(offsets > at) & (offsets <= end)] - at - 1] = False
        first.append(np.flatnonzero(inside & ~before) + at)
        last.append(np.flatnonzero(inside & ~after) + at + 1)
    starts = np.concatenate(first)
    return starts, np.concatenate(last), np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of words, A-Z as a-z, and what ``word_spans`` gives."""
    starts, ends, first = word_spans(data, offsets, kind)
    return span_hashes(data, starts, ends, True), starts, ends, first


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row, at each word, and which of them lie within one value.

    A value with fewer words has its whole sequence as one shingle, at its first word.
    Returns the hashes, whether each counts, and how many count before each value.
    """
    total = len(words)
    wide = np.concatenate((words, np.zeros(size, np.uint64)))
    counts = np.diff(first)
    here = np.repeat(first[1:], counts) - np.arange(total)  # words left in the value
    hashes = np.zeros(total, np.uint64)
    for j in range(size):
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + np.where(here > j, wide[j : j + total], np.uint64(0))
    good = here >= size
    small = first[:-1][(counts > 0) & (counts < size)]
    good[small] = True
    hashes = mix(hashes, size)
    return hashes, good, np.concatenate(([0], np.cumsum(good)))[first]
