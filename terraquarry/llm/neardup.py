"""Near-duplicates by a chosen-path set similarity join.

1. One pass gives each text's shingle set a size, a 128-bit identity and a signature of
   minwise values. Texts of one identity are one class from here on, with a number of its own.
2. In each of several independent trees, a class goes to the node of one of its minwise
   values. Nodes of at most ``node_limit`` classes are compared exhaustively by 4-bit
   sketches; larger nodes branch again, each class by two further minwise values.
   A node gives clusters of classes that may be similar; equal clusters of different
   trees are kept once. No pairs leave a node. The members of a large node are linked to
   the nearest of a few pivots first, as far as full sets confirm it. What is connected so
   needs no more comparison with itself: a node of one component is settled, and where at
   most ``few_limit`` members are outside its largest component, that one meets just those,
   slice by slice. Only nodes with more members outside branch on.
3. Each cluster is resolved on full shingle sets: pairs by falling estimate, those that
   are already connected skipped. It gives at most one edge a member. The sets are made
   again for the members alone: a bitmap of bounded size, joined map-side, holds back the
   other texts, so that no text is shuffled.
4. Components of the edges, and of equal sets, are the groups.

A pair of similarity s shares a node in one tree with probability s (0.8 at the default
threshold), or 0.75 where nodes branch on, and passes the sketch at its lower bound of
five standard deviations: with 12 trees about one pair in 10**6 at the threshold itself
is missed, fewer above it. Links are confirmed on the full sets of 64-bit shingle hashes
(two sets of a million shingles would share a hash by chance once in 10**7 pairs).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraquarry.llm import common
from terraquarry.llm.components import connected_components

#: Minwise values of a signature.
WIDTH = 128
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, (2, WIDTH), dtype=np.uint64)
_NIBBLES = np.uint64(0x1111111111111111)


def shingle_sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data, offsets = common.text_buffers(batch.column("text"))
    words, _, _, first = common.word_hashes(data, offsets, common.NOT_SPACE)
    hashes, good, counts = common.shingle_hashes(words, first, size)
    values = hashes[good]
    for a, b in zip(counts[:-1], counts[1:], strict=True):
        yield np.unique(values[a:b])


def signature(values: np.ndarray) -> np.ndarray:
    """The least of each of WIDTH hashes over a set."""
    least = np.full(WIDTH, 0xFFFFFFFF, np.uint64)
    scale, shift = _SEEDS[0][:, None] | np.uint64(1), _SEEDS[1][:, None]
    for at in range(0, len(values), 2048):
        hashed = values[None, at : at + 2048] * scale
        hashed += shift
        hashed >>= np.uint64(32)
        np.minimum(least, hashed.min(1), out=least)
    return least.astype(np.uint32)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """Four bits of each minwise value: 64 bytes a row, as eight 64-bit words."""
    low = (signatures & 15).astype(np.uint8)
    return np.ascontiguousarray(low[:, 0::2] << 4 | low[:, 1::2]).view(np.uint64)


def mismatches(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many of the WIDTH values differ between a sketch and others."""
    x = others ^ one
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & _NIBBLES).sum(1, dtype=np.int64)


def most_mismatches(threshold: float) -> int:
    """The mismatches that a pair of that similarity exceeds once in some millions."""
    p = threshold + (1 - threshold) / 16
    return int(WIDTH * (1 - p) + 5 * (WIDTH * p * (1 - p)) ** 0.5)


def clusters(sketch: np.ndarray, most: int) -> np.ndarray:
    """A label for each row: connected by at most so many mismatches."""
    labels = np.arange(len(sketch))
    for i in range(len(sketch) - 1):
        near = np.flatnonzero(mismatches(sketch[i], sketch[i + 1 :]) <= most)
        if len(near):
            found = np.unique(labels[near + i + 1])
            if len(found) > 1 or found[0] != labels[i]:
                labels[np.isin(labels, found)] = labels[i]
    return labels


def _identity(values: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return tuple(int(common.mix(values, salt).sum(dtype=np.uint64).astype(np.int64)) for salt in (1, 2))


def _hash_rows(docs: DataFrame, size: int) -> DataFrame:
    """Of each row: doc_id, text_hash, the size of its set, its identity and its signature (null if empty)."""
    names = ["n_shingles", "h1", "h2", "signature"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            rows = []
            for values in shingle_sets(batch, size):
                rows.append((len(values), *_identity(values), signature(values).tobytes() if len(values) else None))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], names=["doc_id", "text_hash", *names])

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, signature binary")


def _signatures(column: pa.Array) -> np.ndarray:
    return common.text_buffers(column)[0].view(np.uint32).reshape(-1, WIDTH)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of eight 64-bit words as binary values."""
    return pa.array([r.tobytes() for r in rows], pa.binary())


NODE = "node long, rep long, sketch binary"
#: Members of a large node that the others are held against.
PIVOTS = 8
#: Members of a pivot's star that are resolved together.
STAR = 256
#: Parts of a node limit's size that a large node is dealt into.
PARTS = 4
#: Bytes of shingle hashes that are resolved together; see ``_edges``.
HELD = 32 << 20


def _roots(classes: DataFrame, trees: int) -> DataFrame:
    """Each class in the node of its minwise value, for each tree."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signatures = _signatures(batch.column("signature"))
            sketch = _fixed(sketches(signatures))
            for tree in range(trees):
                nodes = common.mix(signatures[:, tree].astype(np.uint64), tree + 1 << 40)
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), batch.column("rep"), sketch], names=["node", "rep", "sketch"])

    return classes.select("rep", "signature").mapInArrow(run, NODE)


def _branches(large: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of large nodes in two child nodes each, by two further minwise values."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signatures = _signatures(batch.column("signature"))
            sketch = _fixed(sketches(signatures))
            nodes = batch.column("node").to_numpy().view(np.uint64)
            for branch in (1, 2):
                chosen = (common.mix(nodes, branch) % np.uint64(WIDTH)).astype(np.int64)
                value = signatures[np.arange(len(nodes)), chosen].astype(np.uint64)
                child = common.mix(common.mix(nodes, branch + 2) ^ value)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("rep"), sketch], names=["node", "rep", "sketch"])

    return large.join(classes.select("rep", "signature"), "rep").select("node", "rep", "signature").mapInArrow(run, NODE)


def _sketched(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of nodes (node, rep) with their sketches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = _fixed(sketches(_signatures(batch.column("signature"))))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("rep"), sketch], names=["node", "rep", "sketch"])

    return members.join(classes.select("rep", "signature"), "rep").select("node", "rep", "signature").mapInArrow(run, NODE)


def _blocks(large: DataFrame, classes: DataFrame, node_limit: int) -> DataFrame:
    """The exact way for nodes that stay large: members in blocks, each pair of blocks a node."""
    sizes = large.groupBy("node").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / F.lit(node_limit // 4)).cast("long")
    dealt = large.join(sizes, "node").select("node", "rep", parts.alias("parts"), F.pmod(F.xxhash64("rep"), parts).alias("part"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return _sketched(pairs.select(F.xxhash64("node", F.least("part", "other"), F.greatest("part", "other")).alias("node"), "rep"), classes)


def _parted(nodes: DataFrame, node_limit: int) -> tuple[DataFrame, DataFrame]:
    """Nodes with ``part`` and ``own``: large ones in parts, each with a copy of the node's pivots (``own`` is false); part is -1 in others. And the large nodes' sizes.

    So no task gets a node whole, however many classes hold its value. The pivots are the
    members of least number; Spark takes the first rows of each node before it shuffles.
    """
    sizes = common.materialize(nodes.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > node_limit), "sizes")
    if sizes.isEmpty():
        return nodes.select("node", F.lit(-1).cast("long").alias("part"), "rep", "sketch", F.lit(True).alias("own")), sizes
    marked = nodes.join(sizes, "node", "left")
    parts = F.ceil(F.col("n") / F.lit(max(1, node_limit // PARTS))).cast("long")
    part = F.coalesce(F.pmod(F.xxhash64("rep"), parts), F.lit(-1))
    dealt = marked.select("node", part.alias("part"), "rep", "sketch", F.lit(True).alias("own"))
    first = F.row_number().over(Window.partitionBy("node").orderBy("rep"))
    pivots = nodes.join(sizes, "node").withColumn("at", first).where(F.col("at") <= PIVOTS)
    lent = pivots.select("node", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "rep", "sketch", F.lit(False).alias("own"))
    return dealt.unionByName(lent), sizes


def _compare(nodes: DataFrame, node_limit: int | None, most: int) -> DataFrame:
    """Compare small nodes. Rows: cluster and member; or large node, member and its nearest pivot (itself if none is near). Written to shared storage."""

    def held_against(keys: np.ndarray, reps: np.ndarray, own: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, ...]:
        lent = np.flatnonzero(~own)
        pivots, at = np.unique(reps[lent], return_index=True)
        differ = np.stack([mismatches(p, sketch[own]) for p in sketch[lent[at]]])
        nearest = np.where(differ.min(0) <= most, pivots[differ.argmin(0)], reps[own])
        return keys[own], reps[own], np.ones(len(nearest), bool), nearest

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in common.groups(batches, "node"):
            keys, reps = table.column("node").to_numpy(), table.column("rep").to_numpy()
            part, own = table.column("part").to_numpy(), table.column("own").to_numpy()
            edges = common.runs(keys)
            sizes = np.diff(edges)
            rows = np.flatnonzero(np.repeat(sizes > 1, sizes))
            if not len(rows):
                continue
            sketch = _sketch_rows(table, rows)
            out, at = [], 0
            for i in np.flatnonzero(sizes > 1):
                a, b = edges[i], edges[i + 1]
                mine = sketch[at : at + sizes[i]]
                at += sizes[i]
                if part[a] >= 0:
                    out.append(held_against(keys[a:b], reps[a:b], own[a:b], mine))
                    continue
                members, labels = reps[a:b], clusters(mine, most)
                for label in np.flatnonzero(np.bincount(labels) > 1):
                    same = members[labels == label]
                    name = common.mix(same.view(np.uint64), 5).sum(dtype=np.uint64).astype(np.int64)
                    out.append((np.full(len(same), name), same, np.zeros(len(same), bool), same))
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "rep", "large", "pivot"])

    if node_limit is None:
        dealt, sizes = nodes.select("node", F.lit(-1).cast("long").alias("part"), "rep", "sketch", F.lit(True).alias("own")), None
    else:
        dealt, sizes = _parted(nodes, node_limit)
    ordered = dealt.repartition("node", "part").sortWithinPartitions("node", "rep")
    compared = common.materialize(ordered.mapInArrow(run, "cluster long, rep long, large boolean, pivot long"), "nodes")
    common.drop(sizes)
    return compared


def _sketch_rows(table: pa.Table, rows: np.ndarray) -> np.ndarray:
    column = table.column("sketch").take(pa.array(rows)).combine_chunks()
    return common.text_buffers(column)[0].view(np.uint64).reshape(-1, WIDTH // 16)


def _stars(large: DataFrame) -> DataFrame:
    """Clusters of a pivot and some of the members nearest to it; a pivot has as many as its members fill."""
    near = large.where("pivot <> rep").select("pivot", "rep").distinct()
    parts = near.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(STAR)).cast("long").alias("parts"))
    dealt = near.join(parts, "pivot").select(F.xxhash64("pivot", F.pmod(F.xxhash64("rep"), "parts")).alias("cluster"), "pivot", "rep")
    return dealt.select("cluster", "rep").unionByName(dealt.select("cluster", F.col("pivot").alias("rep"))).distinct()


def _with_component(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with the component that confirmed links give so far (themselves, without a link)."""
    known = labels.select(F.col("node").alias("rep"), "component")
    return members.join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _open(large: DataFrame, labels: DataFrame, few_limit: int) -> DataFrame:
    """Members of nodes that hold several components, with the node's largest one and how many are outside it."""
    members = _with_component(large.select(F.col("cluster").alias("node"), "rep"), labels)
    counts = members.groupBy("node", "component").agg(F.count("*").alias("n"))
    nodes = counts.groupBy("node").agg(F.max(F.struct("n", "component")).alias("major"), F.sum("n").alias("total"))
    nodes = nodes.select("node", F.col("major.component").alias("major"), F.col("major.n").alias("n_major"), (F.col("total") - F.col("major.n")).alias("few"))
    return members.join(nodes.where("few > 0"), "node").withColumn("sliced", F.col("few") <= few_limit)


def _slices(open_: DataFrame, classes: DataFrame, node_limit: int) -> DataFrame:
    """Nodes of a part of the largest component each, with all members outside it, which are few."""
    parts = F.ceil(F.col("n_major") / F.lit(node_limit)).cast("long")
    own = F.pmod(F.xxhash64("rep"), parts)
    every = F.sequence(F.lit(0).cast("long"), parts - 1)
    part = F.explode(F.when(F.col("component") == F.col("major"), F.array(own)).otherwise(every))
    dealt = open_.where("sliced").select("node", "rep", part.alias("part")).select(F.xxhash64("node", "part").alias("node"), "rep")
    return _sketched(dealt, classes)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct values."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    common_ = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
    return 100 * common_ >= percent * (len(a) + len(b) - common_)


#: A cluster of more members is resolved by matrix products.
CROWD = 64


def crowd_labels(sets: list[np.ndarray], percent: int, width: int = 512) -> np.ndarray:
    """A label for each set, connected by links: all intersections at once, some shingles at a time."""
    sizes = np.array([len(s) for s in sets])
    _, shingle, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.flatnonzero(times[shingle] > 1)  # a shingle of one set is in no intersection
    column = (np.cumsum(times > 1) - 1)[shingle[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[shared][order], column[order]
    common_ = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (at, at + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        for row in range(0, len(sets), 256):
            common_[row : row + 256] += part[row : row + 256] @ part.T
    links = np.empty(common_.shape, bool)
    for at in range(0, len(sets), 128):  # in rows, so that no other matrix is whole
        shared_ = common_[at : at + 128].astype(np.int64)
        links[at : at + 128] = 100 * shared_ >= percent * (sizes[at : at + 128, None] + sizes[None, :] - shared_)
    del common_
    labels = np.full(len(sets), -1)
    for start in range(len(sets)):
        if labels[start] < 0:
            labels[start], front = start, links[start]
            while True:
                fresh = np.flatnonzero(front & (labels < 0))
                if not len(fresh):
                    break
                labels[fresh], front = start, links[fresh].any(0)
    return labels


def resolve(reps: np.ndarray, sets: list[np.ndarray], percent: int, most: int) -> list[tuple[int, int]]:
    """Edges that connect the members of a cluster just as their links do, confirmed on full sets."""
    count = len(sets)
    if count == 2:
        return [(int(reps[0]), int(reps[1]))] if linked(*sets, percent) else []
    if count > CROWD:
        labels = crowd_labels(sets, percent)
        return [(int(reps[labels == label].min()), int(r)) for label in np.flatnonzero(np.bincount(labels) > 1) for r in reps[labels == label]]
    sketch = sketches(np.array([signature(s) for s in sets]))
    first, second, worth = [], [], []
    for i in range(count - 1):
        differ = mismatches(sketch[i], sketch[i + 1 :])
        near = np.flatnonzero(differ <= most)
        first.append(np.full(len(near), i))
        second.append(near + i + 1)
        worth.append(differ[near])
    first, second = np.concatenate(first), np.concatenate(second)
    labels = np.arange(count)
    for k in np.argsort(np.concatenate(worth), kind="stable"):
        i, j = first[k], second[k]
        if labels[i] != labels[j] and linked(sets[i], sets[j], percent):
            labels[labels == max(labels[i], labels[j])] = min(labels[i], labels[j])
    return [(int(reps[labels == label].min()), int(r)) for label in np.flatnonzero(np.bincount(labels) > 1) for r in reps[labels == label]]


_KEY = ["doc_id", "h1", "h2"]


def _resolved(docs: DataFrame, wanted: DataFrame, size: int, percent: int, most: int) -> DataFrame:
    """Edges within clusters (cluster, rep, doc_id, h1, h2), confirmed on full sets, which are made again for their members alone."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            values = list(shingle_sets(batch, size))
            h1, h2 = zip(*map(_identity, values), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array([v.tobytes() for v in values], pa.binary())], names=[*_KEY, "shingles"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in common.groups(batches, "cluster"):
            edges, out = common.runs(table.column("cluster").to_numpy()), []
            reps, values = table.column("rep").to_numpy(), table.column("shingles")
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1:
                    out += resolve(reps[a:b], [np.frombuffer(v.as_buffer(), np.uint64) for v in values.slice(a, b - a)], percent, most)
            ends = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    # merges throughout: a join that is broadcast while its table is small would only hide what a large one moves
    near = common.likely(docs, F.xxhash64("doc_id"), wanted.select(F.xxhash64("doc_id").alias("k")).distinct()).where("likely")
    whole = near.select("doc_id", "text").mapInArrow(sets, "doc_id long, h1 long, h2 long, shingles binary")
    whole = whole.groupBy(*_KEY).agg(F.any_value("shingles").alias("shingles"))  # rows that repeat
    dealt = wanted.hint("merge").join(whole, _KEY).select("cluster", "rep", "shingles").repartition("cluster")
    return common.materialize(dealt.sortWithinPartitions("cluster", "rep").mapInArrow(run, "a long, b long"), "links")


def _edges(docs: DataFrame, members: DataFrame, classes: DataFrame, size: int, percent: int, most: int, held: int = HELD) -> DataFrame:
    """Resolve clusters (cluster, rep) on full sets, of which a task holds about ``held`` bytes at a time.

    A cluster of more bytes is dealt into slices of ``held`` bytes, each with the cluster's
    first member, which is linked to most of the others where they are near copies. What the
    slices' links leave in several components meets again, each pair of slices a cluster: so
    every two members meet that are not connected yet, and no link is lost.
    """
    own = [*_KEY, "n_shingles"]
    wanted = common.materialize(members.hint("merge").join(classes.select("rep", *own), "rep"), "wanted")
    weights = wanted.groupBy("cluster").agg(F.sum("n_shingles").alias("w"), F.min(F.struct("rep", *own)).alias("first"))
    heavy = common.materialize(weights.where(F.col("w") * 8 > held), "heavy")
    if heavy.isEmpty():
        edges = _resolved(docs, wanted, size, percent, most)
        common.drop(wanted, heavy)
        return edges
    so_far = F.sum("n_shingles").over(Window.partitionBy("cluster").orderBy("rep").rowsBetween(Window.unboundedPreceding, -1))
    slices = wanted.join(heavy.select("cluster", "first"), "cluster").withColumn("slice", F.floor(F.coalesce(so_far, F.lit(0)) * 8 / F.lit(held)))
    slices = common.materialize(slices, "slices")
    named = lambda *c: F.xxhash64("cluster", *c).alias("cluster")
    parts = slices.select(named("slice"), "rep", *own)
    led = slices.select(named("slice"), "first.*").unionByName(parts).distinct()
    light = wanted.join(heavy.select("cluster"), "cluster", "left_anti").select("cluster", "rep", *own)
    edges = _resolved(docs, light.unionByName(led), size, percent, most)
    labels = connected_components(edges)
    known = _with_component(slices.select("cluster", "rep", *own, "slice"), labels)
    last = known.groupBy("cluster").agg(F.max("slice").alias("last"), (F.min("component") != F.max("component")).alias("mixed")).where("mixed AND last > 0")
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda q: q != F.col("slice"))
    met = known.join(last.select("cluster", "last"), "cluster").withColumn("other", F.explode(others))
    met = met.select(named(F.least("slice", "other"), F.greatest("slice", "other")), "rep", "component", *own)
    several = met.groupBy("cluster").agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select("cluster")
    met = common.materialize(met.drop("component").join(several, "cluster", "left_semi"), "met")
    if not met.isEmpty():
        more = _resolved(docs, met, size, percent, most)
        whole = common.materialize(edges.unionByName(more), "links")
        common.drop(edges, more)
        edges = whole
    common.drop(wanted, heavy, slices, labels, met)
    return edges


def _components(docs: DataFrame, shingle: int, percent: int, trees: int, node_limit: int, few_limit: int | None, depth: int, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n_shingles, h1, h2), and the classes (h1, h2) of several rows or with links.

    ``docs`` is doc_id (long), text, text_hash. Classes have component (a number) and
    component_id (its smallest doc_id).
    """
    few_limit = 4 * node_limit if few_limit is None else few_limit
    most = most_mismatches(percent / 100)
    hashed = common.materialize(_hash_rows(docs, shingle), "sets")
    some = hashed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("signature").alias("signature"))
    classes = common.materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    rows = common.materialize(hashed.drop("signature"), "rows")
    common.drop(hashed)

    nodes, found, stars, labels, spent = _roots(classes, trees), None, None, None, []
    for level in range(depth + 2):
        compared = _compare(nodes, node_limit if level <= depth else None, most)
        spent.append(compared)
        small = compared.where("NOT large").select("cluster", "rep")
        found = small if found is None else found.unionByName(small)
        large = compared.where("large")
        if large.isEmpty():
            break
        star = common.materialize(_stars(large), "stars")
        edges = _edges(docs, star, classes, shingle, percent, most, held)
        spent += [star, edges, labels]
        stars = edges if stars is None else stars.unionByName(edges)
        labels = connected_components(stars)
        open_ = common.materialize(_open(large, labels, few_limit), "open")
        slices = _compare(_slices(open_, classes, node_limit), None, most)
        spent += [open_, slices]
        found = found.unionByName(slices.select("cluster", "rep"))
        rest = open_.where("NOT sliced").select("node", "rep")
        if rest.isEmpty():
            break
        nodes = _branches(rest, classes) if level < depth else _blocks(rest, classes, node_limit)
    members = found.distinct()
    if labels is not None:  # clusters within one component have nothing to add
        known = _with_component(members, labels)
        mixed = known.groupBy("cluster").agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select("cluster")
        members = members.join(mixed, "cluster", "left_semi")
    members = common.materialize(members, "members")
    edges = _edges(docs, members, classes, shingle, percent, most, held)
    last = connected_components(edges if stars is None else edges.unionByName(stars))
    common.drop(members, edges, labels, *spent)

    linked = last.select(F.col("node").alias("rep"), F.col("component").alias("linked"))
    groups = classes.drop("signature").join(linked, "rep", "left").where("n > 1 OR linked IS NOT NULL")
    groups = common.materialize(groups.select("h1", "h2", "doc_id", F.coalesce("linked", "rep").alias("component")), "groups")
    common.drop(classes, last)
    least = groups.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = common.materialize(groups.select("h1", "h2", "component").join(least, "component"), "named")
    common.drop(groups)
    return rows, named


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return common.documents(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, trees: int = 12, node_limit: int = 1024, few_limit: int | None = None, depth: int = 8, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by 100 * intersection >= percent * union of word shingles.

    Words are runs of characters other than space and \\t to \\r, A-Z lower-cased. A text
    of fewer words than a shingle has its whole sequence as one; a text without words has
    none and is linked with nothing. A row per input row: doc_id (integral), n_shingles,
    component_id (the smallest doc_id reachable by links, itself included), kept (whether
    doc_id is component_id).

    A null text counts as empty. A row without a doc_id takes part in no link: its
    component_id is null and it is kept. Rows that share a doc_id are grouped each by its own
    text: equal texts get equal rows, different texts may be in different components. Other
    columns are ignored; an empty table gives no rows.

    Nodes that are large after ``depth`` levels are compared in blocks, exactly. Without
    ``few_limit``, it is four times ``node_limit``. A task holds the sets of one cluster, at
    most ``node_limit + few_limit`` members, and of these sets about ``held`` bytes (a pair of
    slices, twice as many, where links within slices do not connect the cluster).
    """
    common.tune(docs.sparkSession)
    rows, named = _components(_keyed(docs, id_col, text_col), shingle, percent, trees, node_limit, few_limit, depth, held)
    joined = rows.join(named, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, *, shingle: int = 5, percent: int = 80, trees: int = 12, node_limit: int = 1024, few_limit: int | None = None, depth: int = 8, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of ``near_duplicates`` and all rows in none, with all their columns.

    Rows are judged, not ids: of a group the row of least doc_id (and, among its texts, of
    least hash) stays; of rows with that doc_id and text one stays, the one of least hash over
    all columns. Rows without a doc_id, or without a word, all stay.
    """
    common.tune(docs.sparkSession)
    rows, named = _components(_keyed(docs, id_col, text_col), shingle, percent, trees, node_limit, few_limit, depth, held)
    key = ["doc_id", "text_hash"]
    grouped = common.materialize(rows.where("doc_id IS NOT NULL").join(named, ["h1", "h2"]).select(*key, "component"), "grouped")
    first = grouped.groupBy("component").agg(F.min(F.struct(*key)).alias("first")).select("first.*", F.lit(True).alias("first"))
    judged = grouped.groupBy(*key).agg(F.count("*").alias("n")).join(first, key, "left")
    judged = judged.select(*key, F.coalesce("first", F.lit(False)).alias("first"), "n").where("NOT first OR n > 1")
    judged = common.materialize(judged.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("first").alias("_first")), "judged")
    common.drop(rows, named, grouped)

    # the row as one struct, so that no column's name can clash
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("own_id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("own_hash"))
    own = common.likely(own, F.xxhash64("own_id", "own_hash"), judged.select(F.xxhash64("_id", "_hash").alias("k")))
    met = own.where("likely").join(judged, (F.col("own_id") == F.col("_id")) & (F.col("own_hash") == F.col("_hash")), "left")
    repeated = met.where("_first").groupBy("_id", "_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return own.where("NOT likely").select("row.*").unionByName(met.where("_id IS NULL").select("row.*")).unionByName(repeated.select("row.*"))
