"""Footprints that meet, without a common grid: a join on cells of a plane, level by level.

A box lies at the level whose cells are at least as wide and high as it is, so that it touches four
of them at most. Boxes meet in cells of the larger one's level: each shows itself in its own
level's cells, and asks in those of its own and of every larger level that has boxes (of which
there are some dozens at most, whatever the rows). A pair is given by one cell alone, that of
the lower left corner of what the boxes share, so nothing has to be made distinct.

The boxes of a cell are packed into rows of ``PACK`` boxes at most, and the join by cells is one of
such rows: a pair of them is compared as arrays, so a cell of very many boxes is many pairs of rows.
Rows are joined by a merge, never by a broadcast: files and filters say nothing of how many
cells the boxes touch, and a side that looks small may be large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("west", "south", "east", "north")
#: Levels: cells of a side of 2 ** level; smaller boxes (points, too) are at the least level.
LEVELS = range(-20, 31)
#: Boxes in a packed row: two rows make 4 million comparisons, of 4 MB each.
PACK = 2048
#: Pairs in a batch.
BATCH = 50_000
CELL = ("level", "x", "y")


def _level(box: Column) -> Column:
    side = F.greatest(box["east"] - box["west"], box["north"] - box["south"])
    exact = F.when(side > 0, F.ceil(F.log2(side))).otherwise(LEVELS[0]).cast("int")
    # log2 may be off by its last bit: the side decides
    raised = F.when(F.pow(F.lit(2.0), exact) < side, exact + 1).otherwise(exact)
    return F.least(F.greatest(raised, F.lit(LEVELS[0])), F.lit(LEVELS[-1]))


def _spread(x: Column) -> Column:
    """The lower 31 bits of a number, at every second place."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def z_number(column: Column, row: Column) -> Column:
    """A cell's number along the Z curve, of its column and row modulo 2 ** 31."""
    low = lambda c: F.pmod(c, F.lit(1 << 31)).cast("long")
    return _spread(low(column)).bitwiseOR(F.shiftleft(_spread(low(row)), 1))


def _cells(box: Column, level: Column) -> Column:
    """The cells (x, y) of a level that a box touches: at most four where it is no larger than they are."""
    at = lambda c: F.floor(box[c] / F.pow(F.lit(2.0), level)).cast("long")
    across, up = F.sequence(at("west"), at("east")), F.sequence(at("south"), at("north"))
    return F.flatten(F.transform(across, lambda x: F.transform(up, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def _packed(side: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows (keys, level, x, y, name) of the boxes of a cell, ``PACK`` at most; a cell may have many rows."""
    place = [*keys, *CELL]
    boxes = [c for c in side.columns if c not in place]
    schema, pack = side.select(*place, F.array(F.struct(*boxes)).alias(name)).schema, PACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # a cell begins where any of its columns differs from the row before
            new = np.zeros(batch.num_rows, bool)
            for c in place:
                codes = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            starts = np.array([s for a, b in zip(edges, edges[1:], strict=False) for s in range(a, b, pack)], np.int32)
            values = pa.StructArray.from_arrays([batch.column(c) for c in boxes], names=boxes)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, batch.num_rows).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(starts)) for c in place), lists], names=[*place, name])

    dealt = side.hint("rebalance", *(F.col(c) for c in place)).sortWithinPartitions(*place, *(c for c in boxes if c == "before"))
    return dealt.mapInArrow(run, schema)


def _ordered(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Both as numbers of the same order."""
    if pa.types.is_integer(left.type) and left.type == right.type:
        return left.to_numpy(), right.to_numpy()
    codes = np.unique(pa.concat_arrays([left, right]).to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return codes[: len(left)], codes[len(left) :]


def _iou(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """``box_iou`` of arrays, which Spark would not compile for the expression's size."""
    wide = np.minimum(a["east"], b["east"]) - np.maximum(a["west"], b["west"])
    high = np.minimum(a["north"], b["north"]) - np.maximum(a["south"], b["south"])
    both = wide * high
    union = (a["east"] - a["west"]) * (a["north"] - a["south"]) + (b["east"] - b["west"]) * (b["north"] - b["south"]) - both
    return np.divide(both, union, out=np.zeros(len(both)), where=(wide > 0) & (high > 0) & (union > 0))


def _met(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The pairs that meet of each pair of packed rows, each in one cell alone."""
    for batch in batches:
        lists = [batch.column(c) for c in ("left", "right")]
        (la, ra), (left, right) = [n.offsets.to_numpy().tolist() for n in lists], [n.values for n in lists]
        lb, rb = ({c: values.field(c).to_numpy() for c in BOX} for values in (left, right))
        level, x, y = (batch.column(c).to_numpy() for c in CELL)
        timed = left.type.get_field_index("before") >= 0
        first, then = _ordered(left.field("before"), right.field("before")) if timed else (None, None)

        def pairs(found: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            rows, *both = (np.concatenate(n) for n in zip(*((np.full(len(i), row), i, j) for row, i, j in found), strict=True))
            for at in range(0, len(rows), BATCH):
                row, *picks = (pa.array(n[at : at + BATCH]) for n in (rows, *both))
                ids = [s.field("id").take(n) for s, n in zip((left, right), picks, strict=True)]
                iou = _iou(*({c: v[n.to_numpy()] for c, v in s.items()} for s, n in zip((lb, rb), picks, strict=True)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in keys), *ids, pa.array(iou)], names=[*keys, "left_id", "right_id", "iou"])

        found, count = [], 0
        for row in range(batch.num_rows):
            a, b = slice(la[row], la[row + 1]), slice(ra[row], ra[row + 1])
            if timed:  # both are in order: what no pair can have is cut off
                a = slice(a.start, a.start + int(np.searchsorted(first[a], then[b.stop - 1], "left")))
                b = slice(b.start + int(np.searchsorted(then[b], first[la[row]], "right")), b.stop)
                if a.start == a.stop or b.start == b.stop:
                    continue
            hit = lb["west"][a, None] <= rb["east"][None, b]
            hit &= rb["west"][None, b] <= lb["east"][a, None]
            hit &= lb["south"][a, None] <= rb["north"][None, b]
            hit &= rb["south"][None, b] <= lb["north"][a, None]
            if timed and first[a.stop - 1] >= then[b.start]:
                hit &= first[a, None] < then[None, b]
            i, j = np.nonzero(hit)
            i, j, side = i + a.start, j + b.start, 2.0 ** float(level[row])
            own = (np.floor(np.maximum(lb["west"][i], rb["west"][j]) / side) == x[row]) & (np.floor(np.maximum(lb["south"][i], rb["south"][j]) / side) == y[row])
            found.append((row, i[own], j[own]))
            count += int(own.sum())
            if count >= BATCH:
                yield from pairs(found)
                found, count = [], 0
        if count:
            yield from pairs(found)


def meeting(left: DataFrame, right: DataFrame, keys: list[str] = (), before: str | None = None) -> DataFrame:
    """Pairs (keys, left_id, right_id, iou) of boxes of equal keys that meet or touch.

    Both sides have id, west, south, east, north and the keys. A box with a null or infinite
    side, or one that is upside down, meets nothing. Over 2 ** 30 wide boxes touch more cells.
    With ``before``, a column of both sides, pairs alone whose left value is less than the right.
    """
    keys = list(keys)
    good = F.lit(True)
    for c in BOX:
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c).cast("double")) < 1e15)
    good = good & (F.col("west") <= F.col("east")) & (F.col("south") <= F.col("north"))
    more = [F.col(before).alias("before")] if before else []
    if before:
        good = good & F.col(before).isNotNull()
    for c in keys:
        good = good & F.col(c).isNotNull()
    # a file of few bytes may have very many boxes: they are dealt out before they are shown in cells
    sides = [s.where(good).select(*keys, "id", *(F.col(c).cast("double").alias(c) for c in BOX), *more).repartition("id") for s in (left, right)]
    sides = [s.withColumn("level", _level(F.struct(*BOX))) for s in sides]
    levels = sorted(r.level for r in sides[0].select("level").unionByName(sides[1].select("level")).distinct().collect())  # of LEVELS at most

    def placed(side: DataFrame) -> DataFrame:
        at = side.withColumn("cell", F.explode(_cells(F.struct(*BOX), F.col("level"))))
        return at.select("*", "cell.x", "cell.y").drop("cell")

    def asking(side: DataFrame, own: bool) -> DataFrame:
        """In the cells of each larger level, and of its own if it is for this side to ask there."""
        more = F.filter(F.array(*map(F.lit, levels)), lambda v: (v >= F.col("level")) if own else (v > F.col("level")))
        return placed(side.withColumn("at", F.explode(more)).drop("level").withColumnRenamed("at", "level"))

    kinds = [f"{c} {side.schema[c].dataType.simpleString()}" for side in sides[:1] for c in keys]
    schema = ", ".join([*kinds, *(f"{n}_id {s.schema['id'].dataType.simpleString()}" for n, s in zip(("left", "right"), sides, strict=True)), "iou double"])

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = _packed(a, keys, "left").join(_packed(b, keys, "right").hint("merge"), [*keys, *CELL])
        return pairs.mapInArrow(lambda batches: _met(batches, keys), schema)

    return joined(placed(sides[0]), asking(sides[1], True)).unionByName(joined(asking(sides[0], False), placed(sides[1])))


def overlapping_pairs(tiles: DataFrame, keys: list[str] = (), min_iou: float = 0.0) -> DataFrame:
    """(keys, reference_id, comparison_id, iou) of tiles (id, acquired, box) that share some area, earlier first; tiles of one instant are no pair.

    ``min_iou`` is the least share of the union that a pair must have in common.
    """
    if not 0 <= min_iou <= 1:
        raise ValueError("min_iou must be 0 to 1")
    met = meeting(tiles, tiles, keys, before="acquired")
    found = met.select(*keys, F.col("left_id").alias("reference_id"), F.col("right_id").alias("comparison_id"), "iou")
    return found.where((F.col("iou") > 0) & (F.col("iou") >= min_iou))
