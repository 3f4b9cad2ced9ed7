"""Benchmark decontamination: SimHash fingerprints of item-sized windows, verified exactly.

The benchmark is the stated query set: it is read in blocks of bounded size, and each
block is broadcast to one map pass over the documents. For each item the windows of a
document that have as many shingles as the item are searched, wherever a window holds at
least one shingle of an item (no other can be similar). A multi-index of Hamming blocks
gives all items within the radius of a window's fingerprint: each block has a radius of its
own, and the block radii are such that one block at least is within its own whenever the
whole is. Each such item is verified by the weighted Jaccard similarity of shingle counts,
exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terraquarry.llm import common

#: Bits of a fingerprint, and of a block of it. Windows of equal size that share 8 of 9
#: shingles (a similarity of 0.8) differ in 39 of 256 bits on average, with a deviation of 6.
BITS, BLOCK_BITS = 256, 32
#: Five deviations more: of pairs at the threshold itself some three in 10**7 are missed.
#: Unrelated windows differ in 128 bits, with a deviation of 8.
RADIUS = 67
#: Windows that are searched at once.
QUERIES = 512


def shingle_bits(hashes: np.ndarray) -> np.ndarray:
    """BITS pseudo-random bits of each shingle, as 0 or 1."""
    words = np.stack([common.mix(hashes, 101 + i) for i in range(BITS // 64)], 1)
    return np.unpackbits(words.view(np.uint8), axis=1)


def fingerprint(sums: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """SimHash: the majority of the bits of each window's shingles, as BITS // BLOCK_BITS blocks."""
    return np.packbits(2 * sums > np.reshape(size, (-1, 1)), axis=1).view(np.uint32)


class MultiIndex:
    """All stored fingerprints within a Hamming radius of a query.

    Block radii sum to radius - blocks + 1: if every block were beyond its own, the whole
    would be beyond ``radius``. Each block has its stored values in buckets, and a query
    opens those within the block's radius, about 1 in 1,000 of unrelated ones.
    """

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        blocks = prints.shape[1]
        least, more = divmod(radius - blocks + 1, blocks)
        self.radii = [least + (b < more) for b in range(blocks)]
        self.buckets = [np.unique(prints[:, b], return_inverse=True) for b in range(blocks)]

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        """A matrix of queries by fingerprints: whether a block opens the fingerprint's bucket."""
        out = np.zeros((len(queries), len(self.prints)), bool)
        for b, (radius, (values, bucket)) in enumerate(zip(self.radii, self.buckets, strict=True)):
            near = np.bitwise_count(queries[:, b, None] ^ values) <= radius
            open_ = np.flatnonzero(near.any(1))
            out[open_] |= near[open_][:, bucket]
        return out

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a fingerprint that are at most ``radius`` bits apart."""
        query, at = np.nonzero(self.candidates(queries))
        near = np.bitwise_count(queries[query] ^ self.prints[at]).sum(1, dtype=np.int64) <= self.radius
        return query[near], at[near]


class Items:
    """A block of benchmark items, ready to be searched."""

    def __init__(self, ids: list, texts: list[str], shingle: int, threshold: float, short_items: bool = False):
        self.ids, self.shingle, self.threshold = ids, shingle, threshold
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
        data, offsets = common.text_buffers(batch.column("text"))
        words, _, _, first = common.word_hashes(data, offsets, common.WORD_BYTES)
        hashes, good, counts = common.shingle_hashes(words, first, shingle)
        self.words = np.diff(first)
        #: By word count, the hashes of items of fewer words than a shingle, and these items.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if short_items:
            for size in range(1, shingle):
                if len(members := np.flatnonzero(self.words == size)):
                    whole = common.shingle_hashes(words, first, size)[0][first[members]]
                    order = np.argsort(whole, kind="stable")
                    self.short[size] = whole[order], members[order]
            good &= np.repeat(self.words >= shingle, self.words)
            counts = np.concatenate(([0], np.cumsum(good)))[first]
        own = hashes[good]
        self.shingles = [own[a:b] for a, b in zip(counts[:-1], counts[1:], strict=True)]
        self.counted = [np.unique(s, return_counts=True) for s in self.shingles]
        self.sizes = np.diff(counts)
        #: Distinct shingles, and the sizes of items that have each.
        pairs = np.unique(np.stack([own, np.repeat(self.sizes, self.sizes).astype(np.uint64)], 1), axis=0) if len(own) else np.empty((0, 2), np.uint64)
        self.known, at = np.unique(pairs[:, 0], return_index=True)
        self.size_start = np.append(at, len(pairs))
        self.size_of = pairs[:, 1].astype(np.int64)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.known >> np.uint64(42)).astype(np.int64)] = True
        self.by_size: dict[int, tuple[np.ndarray, MultiIndex]] = {}
        for size in np.unique(self.sizes[self.sizes > 0]).tolist():
            members = np.flatnonzero(self.sizes == size)
            prints = fingerprint(np.stack([shingle_bits(self.shingles[m]).sum(0, dtype=np.int64) for m in members]), size)
            self.by_size[size] = members, MultiIndex(prints)

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of shingle counts."""
        values, counts = self.counted[item]
        own, times = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        same = values[at] == own
        shared = int(np.minimum(counts[at[same]], times[same]).sum())
        return shared / (len(window) + int(counts.sum()) - shared)

    def search(self, hashes: np.ndarray) -> list[tuple[int, float, int]]:
        """The items that a document contains: index, similarity, first word of the best window.

        ``hashes`` are the document's shingles in order.
        """
        hit = np.flatnonzero(self.filter[(hashes >> np.uint64(42)).astype(np.int64)])
        if len(hit):
            at = np.minimum(np.searchsorted(self.known, hashes[hit]), len(self.known) - 1)
            same = self.known[at] == hashes[hit]
            hit, at = hit[same], at[same]
        if not len(hit):
            return []
        counts = self.size_start[at + 1] - self.size_start[at]
        place = np.repeat(hit, counts)
        which = np.repeat(self.size_start[at], counts) + np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)
        sizes = self.size_of[which]
        best: dict[int, tuple[float, int]] = {}
        for size in np.unique(sizes).tolist():
            self._windows(hashes, place[sizes == size], size, best)
        return [(item, s, w) for item, (s, w) in sorted(best.items())]

    def _windows(self, hashes: np.ndarray, hits: np.ndarray, size: int, best: dict[int, tuple[float, int]]) -> None:
        window = min(size, len(hashes))
        members, index = self.by_size[size]
        for a, b in _stretches(hits, window):
            for first in range(max(0, a - window + 1), min(b, len(hashes) - window) + 1, QUERIES):
                starts = np.arange(first, min(first + QUERIES, min(b, len(hashes) - window) + 1))
                sums = np.concatenate((np.zeros((1, BITS), np.int32), np.cumsum(shingle_bits(hashes[first : starts[-1] + window]), axis=0, dtype=np.int32)))
                query, near = index.within(fingerprint(sums[starts - first + window] - sums[starts - first], window))
                for start, item in zip(starts[query].tolist(), members[near].tolist(), strict=True):
                    s = self.similarity(item, hashes[start : start + window])
                    if s >= self.threshold - 1e-12 and s > best.get(item, (0.0, 0))[0]:
                        best[item] = s, start


def _short_rows(items: Items, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The short items that documents contain word for word: document, item, first word."""
    for size, (known, members) in items.short.items():
        hashes, good, _ = common.shingle_hashes(words, first, size)
        at = np.flatnonzero(good & np.isin(hashes, known))
        doc = np.searchsorted(first, at, "right") - 1
        _, once = np.unique(np.stack([doc.astype(np.uint64), hashes[at]], 1), axis=0, return_index=True)
        for i in once.tolist():
            a, b = (np.searchsorted(known, hashes[at[i]], side) for side in ("left", "right"))
            for item in members[a:b].tolist():
                yield int(doc[i]), item, int(at[i] - first[doc[i]])


def _stretches(places: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """First and last of runs of sorted places that are at most ``gap`` apart."""
    cut = np.flatnonzero(np.diff(places) > gap)
    return list(zip(places[np.append(0, cut + 1)].tolist(), places[np.append(cut, len(places) - 1)].tolist(), strict=True))


def item_blocks(benchmark: DataFrame, items: int, block_bytes: int) -> Iterator[tuple[list, list[str]]]:
    """The benchmark's ids and texts in blocks of bounded size, one partition at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.toLocalIterator():
        if ids and (len(ids) >= items or size + len(row.text) > block_bytes):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text)
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, *, shingle: int = 5, threshold: float = 0.8, short_items: bool = False, block_items: int = 10_000, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The benchmark items that documents contain, a row per document and item.

    doc_id, item_id, similarity (of the best window), first_word (of that window, from 0),
    n_words (of the item). Words are runs of ASCII letters, digits, "_" and characters
    beyond ASCII, A-Z lower-cased. An item or a document of fewer words than a shingle has
    its whole sequence as one shingle, and a document shorter than an item is its only
    window. With ``short_items``, an item of fewer words than a shingle is found wherever
    its words stand in a row, at similarity 1. Null and wordless texts match nothing; null
    ids stay null, and ids may have any type; repeated documents and repeated items each
    have their own rows; other columns are ignored; without documents or items there are
    no rows.

    The benchmark goes to the executors in blocks of at most ``block_items`` items and
    ``block_bytes`` characters, each with a pass over the documents: any size works. Of
    several blocks, one is held at a time: its rows are written before the next is read.
    """
    spark = docs.sparkSession
    common.tune(spark)
    docs = common.documents(docs, id_col, text_col)
    items = _items(benchmark, item_col, item_text_col)
    kind = items.schema["item_id"].dataType
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {kind.simpleString()}, similarity double, first_word long, n_words long"
    found = None
    for block, more in _blocks(spark, items, shingle, threshold, short_items, block_items, block_bytes):
        part = docs.mapInArrow(_pass(block, to_arrow_type(kind)), schema)
        if more:
            part = common.materialize(part, "leaks")
            block.destroy()
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))


def _blocks(spark, items: DataFrame, shingle: int, threshold: float, short_items: bool, block_items: int, block_bytes: int):
    """Broadcast blocks of items one after another, and whether there is more than one block."""
    blocks = item_blocks(items, block_items, block_bytes)
    ahead, several = next(blocks, None), False
    while ahead is not None:
        now, ahead = ahead, next(blocks, None)
        several |= ahead is not None
        yield spark.sparkContext.broadcast(Items(*now, shingle, threshold, short_items)), several


def _found(batches: Iterable[pa.RecordBatch], items: Items, column: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, float, int]]]]:
    """Batches, and what stands in each: row, item, similarity, first word."""
    for batch in common.chunks(batches, column):
        data, offsets = common.text_buffers(batch.column(batch.schema.names.index(column)))
        words, _, _, first = common.word_hashes(data, offsets, common.WORD_BYTES)
        hashes, good, counts = common.shingle_hashes(words, first, items.shingle)
        hashes = hashes[good]
        known = items.filter[(hashes >> np.uint64(42)).astype(np.int64)]
        before = np.concatenate(([0], np.cumsum(known)))[counts]
        rows = []
        for at in np.flatnonzero(np.diff(before)).tolist():
            rows += [(at, *f) for f in items.search(hashes[counts[at] : counts[at + 1]])]
        rows += [(at, item, 1.0, start) for at, item, start in _short_rows(items, words, first)]
        yield batch, rows


def _pass(block, kind: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = block.value
        for batch, rows in _found(batches, items, "text"):
            if rows:
                at, which, similarity, start = zip(*rows, strict=True)
                ids = pa.array([items.ids[i] for i in which], kind)
                sizes = pa.array(items.words[list(which)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), ids, pa.array(similarity, pa.float64()), pa.array(start, pa.int64()), sizes], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return run


def _without(block, column: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _found(batches, block.value, column):
            keep = np.ones(batch.num_rows, bool)
            keep[[r[0] for r in rows]] = False
            yield batch.filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, shingle: int = 5, threshold: float = 0.8, short_items: bool = False, block_items: int = 10_000, block_bytes: int = 8 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows whose text contains no benchmark item, with all their columns.

    Each row is judged by its own text, in the same pass that drops it: rows that share an
    id, or have none, need not share their fate. For the rest, see ``contaminated``.
    """
    spark = docs.sparkSession
    common.tune(spark)
    before = None
    for block, several in _blocks(spark, _items(benchmark, item_col, item_text_col), shingle, threshold, short_items, block_items, block_bytes):
        docs = docs.mapInArrow(_without(block, text_col), docs.schema)
        if several:
            docs = common.materialize(docs, "clean")
            block.destroy()
            common.drop(before)
            before = docs
    return docs
