"""Exact inner-product search with metadata filters."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import TimestampNTZType

from terraquarry.functions.scalars import boxes_touch, dot, filter_datetime, rounded

#: Queries that are searched in one pass: their vectors and a batch's scores stay under 70 MB.
BLOCK = 2048
#: Bytes of vectors in a block, and in the part of them that a task reads at once.
PACKED, PART = 2 << 20, 64 << 20
#: Pairs whose products are summed in order at once.
CHUNK = 100_000
#: Fixed value: how far a vector's length may be from 1.
UNIT_TOLERANCE = 2e-3


def metadata_filter(
    tiles: DataFrame,
    modality: str | None = None,
    date_from=None,
    date_to=None,
    scene_id: str | None = None,
    bbox: Sequence[float] | None = None,
) -> DataFrame:
    """Tiles that meet all given conditions; a null field meets none. Catalyst pushes them to the scan.

    Columns: modality, acquired (timestamp), scene_id and west, south, east, north.
    Dates (text, date or datetime; UTC) are inclusive; a date alone as ``date_to`` means the end
    of that day. Wrong types are TypeErrors, wrong values ValueErrors.
    """
    if modality is not None:
        tiles = tiles.where(F.lower(F.trim("modality")) == checked_modality(modality))
    first, last = filter_datetime(date_from), filter_datetime(date_to, end_of_day=True)
    if first is not None and last is not None and first > last:
        raise ValueError("date_from is after date_to")
    kind = tiles.schema["acquired"].dataType if (first or last) else None
    at = lambda t: F.lit(t.replace(tzinfo=None) if isinstance(kind, TimestampNTZType) else t).cast(kind)
    if first is not None:
        tiles = tiles.where(F.col("acquired") >= at(first))
    if last is not None:
        tiles = tiles.where(F.col("acquired") <= at(last))
    if scene_id is not None:
        if not isinstance(scene_id, str):
            raise TypeError("scene_id must be a string")
        if not scene_id.strip():
            raise ValueError("scene_id can't be empty")
        tiles = tiles.where(F.col("scene_id") == scene_id.strip())
    if bbox is not None:
        box = checked_box(bbox)
        tiles = tiles.where(boxes_touch([F.col(c) for c in ("west", "south", "east", "north")], [F.lit(x) for x in box]))
    return tiles


def checked_modality(modality: str) -> str:
    if not isinstance(modality, str):
        raise TypeError(f"modality must be a string, not {type(modality).__name__}")
    if modality.strip().lower() not in ("optical", "sar"):
        raise ValueError(f"unsupported modality {modality!r}: optical or sar")
    return modality.strip().lower()


def checked_box(bbox: Sequence[float]) -> list[float]:
    """west, south, east, north as floats."""
    if isinstance(bbox, str | bytes | dict) or not isinstance(bbox, Sequence | np.ndarray):
        raise TypeError("a box is a sequence of four numbers")
    if len(bbox) != 4:
        raise ValueError(f"a box has four numbers, not {len(bbox)}")
    if any(isinstance(x, bool) or not isinstance(x, int | float | np.integer | np.floating) for x in bbox):
        raise TypeError("a box's coordinates are numbers")
    box = [float(x) for x in bbox]
    if box[0] > box[2] or box[1] > box[3]:
        raise ValueError("a box is west, south, east, north")
    return box


def checked_k(k: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int):
        raise TypeError("k must be an integer")
    if k < 1:
        raise ValueError("k must be positive")
    return k


def checked_vector(vector: Sequence[float], dimension: int | None = None) -> list[float]:
    """A query vector of length 1: one that is off by more than the tolerance is scaled, a zero one an error."""
    array = np.asarray(vector, np.float32)
    array = array[0] if array.ndim == 2 and len(array) == 1 else array
    if array.ndim != 1 or (dimension is not None and len(array) != dimension):
        raise ValueError(f"a query vector has the shape ({dimension},), not {array.shape}")
    length = float(np.linalg.norm(array))
    if not length > 0:
        raise ValueError("a query vector can't be all zeros")
    return (array if abs(length - 1) <= UNIT_TOLERANCE else array / length).astype(float).tolist()


def exact_score(score: Column) -> Column:
    """What rows are ranked by: a score to 12 places, so that the order of a sum's terms (which tasks and matrix products choose) decides nothing."""
    return F.floor(score * 1e12 + 0.5) / 1e12


def _exact(scores: np.ndarray) -> np.ndarray:
    return np.floor(scores * 1e12 + 0.5) / 1e12


def best(vectors: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id") -> DataFrame:
    """The k best rows by score to 12 places, ties by id: partial top-k per task, then one merge of k rows each."""
    return vectors.withColumn("score", exact_score(dot(F.col("embedding"), query))).orderBy(F.desc("score"), id_col).limit(checked_k(k))


def top_k(vectors: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id") -> DataFrame:
    """The k best rows by score, ties by id.

    ``query`` is an array column, in general a literal. Scores are ranked to 12 places and
    shown to 6.
    """
    return best(vectors, query, k, id_col).withColumn("score", rounded(F.col("score")))


def _blocks(rows: DataFrame, size: int, columns: list[str]) -> DataFrame:
    """Rows of ``size`` vectors at most: number, ids, vectors (doubles or floats as bytes, row by row) and a list for each other column."""
    kind = {c: rows.schema[c].dataType for c in columns}
    schema = ", ".join(["number long", f"ids array<{rows.schema['id'].dataType.simpleString()}>", "vectors binary", *(f"`{c}` array<{k.simpleString()}>" for c, k in kind.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        number = TaskContext.get().partitionId() << 32

        def block(table: pa.Table) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), _one(table.column(c))) for c in ("id", *columns)]
            matrix = _matrix(table.column("embedding"), table.num_rows)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), lists[0], pa.array([matrix.tobytes()], pa.binary()), *lists[1:]], names=["number", "ids", "vectors", *columns])

        for batch in batches:
            held, count = [*held, batch], count + batch.num_rows
            if count >= size:
                table = pa.Table.from_batches(held)
                for at in range(0, count - size + 1, size):
                    yield block(table.slice(at, size))
                    number += 1
                rest = table.slice(count - count % size)
                held, count = rest.to_batches(), rest.num_rows
        if count:
            yield block(pa.Table.from_batches(held))

    return rows.select("id", F.col("embedding").cast("array<double>").alias("embedding"), *columns).mapInArrow(run, schema)


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole


def _names(ids: pa.Array) -> np.ndarray:
    return ids.to_numpy() if pa.types.is_integer(ids.type) and not ids.null_count else np.array(ids.to_pylist())


def _crossed(queries: DataFrame, vectors: DataFrame, block: int, work: Callable[[pa.RecordBatch, Iterator[tuple[np.ndarray, np.ndarray]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` for every block of queries: it gets the block (a row of ``_blocks``) and the (ids, matrix) of the vectors, block by block.

    ``queries`` has id, embedding and other columns, ``vectors`` id and embedding. Up to ``block``
    queries are one block, which is broadcast (it is collected first, so its size is known), and
    no vector is shuffled. More are packed into blocks, and so are the vectors; Spark's cartesian
    product pairs the blocks: each side is shuffled and stored once, whatever the number of pairs,
    and a task reads one part of the vectors, of ``PART`` bytes at most, for each of its blocks of queries.
    """
    spark, extra = vectors.sparkSession, [c for c in queries.columns if c not in ("id", "embedding")]
    slim = vectors.select("id", "embedding")
    some = queries.limit(block + 1).toArrow()
    if some.num_rows <= block:
        lists = {c: pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), _one(some.column(c))) for c in ("id", *extra)}
        matrix = _matrix(some.column("embedding"), some.num_rows) if some.num_rows else np.empty((0, 0))
        row = pa.RecordBatch.from_arrays([pa.array([matrix.tobytes()], pa.binary()), *lists.values()], names=["vectors", "ids", *extra])
        held = spark.sparkContext.broadcast(row)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if len(held.value.column("ids")[0]):
                sliced = (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK))
                yield from work(held.value, ((_names(b.column("id")), _matrix(b.column("embedding"), b.num_rows)) for b in sliced))

        return slim.mapInArrow(run, schema)
    of = lambda rows: rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    asked, given = of(queries), of(slim)
    if not given.n:
        return spark.createDataFrame([], schema)
    # small tables have smaller blocks, so that all tasks have some
    size = lambda n, d: max(1, min(BLOCK, max(block, n // 64), PACKED // (8 * max(1, d))))
    mine, theirs = size(asked.n, asked.d), size(given.n, given.d)
    left = _blocks(queries, mine, extra).repartition(-(-asked.n // mine))
    right = _blocks(slim, theirs, []).select(F.col("ids").alias("their_ids"), F.col("vectors").alias("their_vectors")).repartition(-(-given.n * given.d * 8 // PART))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (b.slice(at, 1) for b in batches for at in range(b.num_rows))
        for _, group in itertools.groupby(rows, lambda r: r.column("number")[0].as_py()):
            first = next(group)
            theirs = ((_names(r.column("their_ids").flatten()), r.column("their_vectors")) for r in itertools.chain([first], group))
            yield from work(first, ((ids, np.frombuffer(v[0].as_buffer()).reshape(len(ids), -1)) for ids, v in theirs))

    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(met, schema)


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _own(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """A block's ids and matrix."""
    ids = _names(row.column("ids").flatten())
    return ids, np.frombuffer(row.column("vectors")[0].as_buffer()).reshape(len(ids), -1)


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products to 12 places, summed in order as ``dot`` and the SQL do: what a product of matrices makes of the last bits decides nothing."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return _exact(total)


def _margin(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far apart a row's product by matrices and one in order to 12 places may be."""
    lengths = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max(initial=0)
    return 1e-12 + 4e-16 * (a.shape[1] + 2) * lengths


def search_all(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """The k best of all rows for each query row, itself excluded: (query_id, id, score, rank).

    Both sides are (id, embedding), with ids of one type; an id is one row of its side. Blocks of
    both sides meet in tasks (``_crossed``), which multiply matrices and keep k rows a query; one
    window merges those partial lists. Scores are ranked to 12 places and shown to 6.
    """
    checked_k(k)
    kind = vectors.schema["id"].dataType
    arrow = to_arrow_type(kind)
    partial = _crossed(queries.select("id", "embedding"), vectors, block, lambda row, given: _best(given, *_own(row), k, arrow), f"query_id {kind.simpleString()}, id {kind.simpleString()}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("score", rounded(F.col("score")))


def _best(given: Iterator[tuple[np.ndarray, np.ndarray]], own: np.ndarray, matrix: np.ndarray, k: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The k best rows for each query: running lists that each block's better rows are merged into."""
    rows, ids, scores = np.empty(0, np.int64), own[:0], np.empty(0)  # the lists, sorted by row, score and id
    least = np.full(len(own), -np.inf)  # the k-th best score so far
    for names, theirs in given:
        if not len(names):
            continue
        found, slack = matrix @ theirs.T, _margin(matrix, theirs)
        shared = np.flatnonzero(np.isin(names, own))
        if len(shared):
            part = found[:, shared]
            part[own[:, None] == names[shared][None]] = -np.inf
            found[:, shared] = part
        bar = least
        if not np.isfinite(least).all() and len(names) > k:
            bar = np.maximum(least, np.partition(found, -k, axis=1)[:, -k] - slack)
        q, at = np.nonzero(found >= (bar - slack)[:, None])
        keep = found[q, at] > -np.inf
        q, at = q[keep], at[keep]
        if not len(q):
            continue
        exact = np.concatenate([_in_order(matrix[q[i : i + CHUNK]], theirs[at[i : i + CHUNK]]) for i in range(0, len(q), CHUNK)])
        touched = np.zeros(len(own), bool)
        touched[q] = True
        old = touched[rows]
        r, n, s = np.concatenate((rows[old], q)), np.concatenate((ids[old], names[at])), np.concatenate((scores[old], exact))
        order = np.lexsort((n, -s, r))
        r, n, s = r[order], n[order], s[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        r, n, s, place = (v[place < k] for v in (r, n, s, place))
        least[r[place == k - 1]] = s[place == k - 1]
        rows, ids, scores = (np.concatenate((v[~old], w)) for v, w in ((rows, r), (ids, n), (scores, s)))
    if len(rows):
        yield pa.RecordBatch.from_arrays([pa.array(own[rows].tolist(), kind), pa.array(ids.tolist(), kind), pa.array(scores)], names=["query_id", "id", "score"])


def target_ranks(targets: DataFrame, vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rank of one stated row among all for each query: (query_id, rank), without ranking the others.

    ``targets`` is (id, embedding, target_id, target_embedding); its ids are the queries'. The
    rank is one more than the rows of a higher score, or of the same and a smaller id. Blocks of
    both sides meet as in ``search_all``; what is shuffled after that is a count a query and part.
    """
    kind = targets.schema["id"].dataType
    arrow = to_arrow_type(kind)
    # the score to beat, as ``dot`` has it
    goals = targets.select("id", "embedding", "target_id", exact_score(dot(F.col("embedding"), F.col("target_embedding"))).alias("goal"))

    def run(row: pa.RecordBatch, given: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        _, matrix = _own(row)
        ids, goal = _names(row.column("target_id").flatten()), row.column("goal").flatten().to_numpy(zero_copy_only=False)
        better = np.zeros(len(goal), np.int64)
        for names, theirs in given:
            if not len(names):
                continue
            found, slack = matrix @ theirs.T, 2 * _margin(matrix, theirs)
            better += (found > (goal + slack)[:, None]).sum(1)
            q, at = np.nonzero((found >= (goal - slack)[:, None]) & (found <= (goal + slack)[:, None]))  # too near to tell
            for i in range(0, len(q), CHUNK):
                one, other = q[i : i + CHUNK], at[i : i + CHUNK]
                exact = _in_order(matrix[one], theirs[other])
                over = (exact > goal[one]) | ((exact == goal[one]) & (names[other] < ids[one]))
                better += np.bincount(one[over], minlength=len(goal))
        yield pa.RecordBatch.from_arrays([row.column("ids").flatten().cast(arrow), pa.array(better)], names=["query_id", "n"])

    counts = _crossed(goals, vectors, block, run, f"query_id {kind.simpleString()}, n long")
    return counts.groupBy("query_id").agg((F.sum("n") + 1).alias("rank"))
