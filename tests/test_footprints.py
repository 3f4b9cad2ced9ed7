"""Footprints that meet against the nested loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraquarry.operators import footprints

BOX = "west double, south double, east double, north double"


def boxes(seed, count):
    """Boxes of sides from 1e-4 to 100, points, lines, boxes on whole coordinates that touch, copies."""
    rng = np.random.default_rng(seed)
    side = 10.0 ** rng.uniform(-4, 2, (count, 2))
    corner = rng.uniform(-60, 60, (count, 2))
    out = [(float(x), float(y), float(x + w), float(y + h)) for (x, y), (w, h) in zip(corner, side)]
    out += [(float(x), float(y), float(x + w), float(y + h)) for x, y, w, h in zip(*rng.integers(-4, 5, (2, 60)).tolist(), *rng.integers(0, 4, (2, 60)).tolist())]
    return out + out[:5] + [(-1e9, -1e9, 1e9, 1e9)]


def test_meeting_equals_the_nested_loop(spark):
    a, b = boxes(1, 120), boxes(2, 150)
    frames = [spark.createDataFrame([(i, i % 2, *x) for i, x in enumerate(v)], f"id long, k int, {BOX}") for v in (a, b)]
    odd = spark.createDataFrame([(9000, 0, None, 0.0, 1.0, 1.0), (9001, 0, 2.0, 0.0, 1.0, 1.0), (9002, 0, float("nan"), 0.0, 1.0, 1.0), (9003, None, 0.0, 0.0, 1.0, 1.0)], f"id long, k int, {BOX}")
    touch = lambda p, q: p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]
    for keys in ([], ["k"]):
        got = sorted((r.left_id, r.right_id) for r in footprints.meeting(frames[0].unionByName(odd.where("k = 0")), frames[1], keys).collect())
        assert got == sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if touch(p, q) and (not keys or i % 2 == j % 2))
    assert footprints.meeting(frames[0].limit(0), frames[1]).count() == 0


def test_overlapping_pairs(spark):
    given = boxes(5, 100)
    frame = spark.createDataFrame([(i, i % 7, *x) for i, x in enumerate(given)], f"id long, acquired int, {BOX}")
    want = {}
    for i, p in enumerate(given):
        for j, q in enumerate(given):
            w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
            if i % 7 < j % 7 and w > 0 and h > 0:
                want[i, j] = w * h / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - w * h)
    rows = footprints.overlapping_pairs(frame).collect()
    assert len(rows) == len(want) and all(abs(want[r.reference_id, r.comparison_id] - r.iou) < 1e-12 for r in rows)
    assert footprints.overlapping_pairs(frame, min_iou=0.2).count() == sum(v >= 0.2 for v in want.values())
    with pytest.raises(ValueError):
        footprints.overlapping_pairs(frame, min_iou=2)


def test_cells_are_numbered_along_the_curve(spark):
    cells = [(x, y) for x in range(8) for y in range(8)] + [(2**31 - 1, 2**31 - 1), (-1, -1), (2**30, 0)]
    frame = spark.createDataFrame(cells, "x long, y long").select("x", "y", footprints.z_number(F.col("x"), F.col("y")).alias("z"))
    bits = lambda n: sum((n >> i & 1) << 2 * i for i in range(31))
    for r in frame.collect():
        assert r.z == bits(r.x % 2**31) | bits(r.y % 2**31) << 1


def test_no_side_is_broadcast_for_its_small_files(spark, tmp_path):
    """200,000 boxes of one place in a file of some KB, whose exploded cells don't show in its size."""
    spark.range(200_000).selectExpr("id % 400 AS id", "CAST(id AS INT) AS acquired", *(f"{v}D AS {c}" for c, v in zip(footprints.BOX, (0.1, 0.1, 0.2, 0.2)))).write.parquet(str(tmp_path / "t"))
    plan = footprints.overlapping_pairs(spark.read.parquet(str(tmp_path / "t"))).select("iou")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_cells_of_many_rows(spark, monkeypatch):
    """Cells in several packed rows, instants of other types than integers, boxes without one."""
    monkeypatch.setattr(footprints, "PACK", 7)
    given = [(i, f"2024-01-{1 + i % 9:02d}" if i % 10 else None, 0.1 * (i % 11), 0.0, 0.1 * (i % 11) + 0.15, 1.0) for i in range(120)]
    want = sorted((p[0], q[0]) for p in given for q in given if p[1] and q[1] and p[1] < q[1] and min(p[4], q[4]) > max(p[2], q[2]))
    frame = spark.createDataFrame(given, f"id long, acquired string, {BOX}")
    for kind in ("string", "date", "timestamp"):
        rows = footprints.overlapping_pairs(frame.withColumn("acquired", F.col("acquired").cast(kind))).collect()
        assert sorted((r.reference_id, r.comparison_id) for r in rows) == want
