"""Rasters over many blocks against plain flood fill and counting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraquarry.operators import change, graph, kernels
from terraquarry.plans import catalogue


def flood(mask):
    """Component (least row * width + column) and area of each pixel, by a stack."""
    width, out = mask.shape[1], {}
    for start in zip(*np.nonzero(mask)):
        if start in out:
            continue
        stack, seen = [start], {start}
        while stack:
            r, c = stack.pop()
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    p = (r + i, c + j)
                    if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < width and mask[p] and p not in seen:
                        seen.add(p)
                        stack.append(p)
        name = min(r * width + c for r, c in seen)
        out |= {p: (name, len(seen)) for p in seen}
    return {(int(r), int(c)): (int(n), a) for (r, c), (n, a) in out.items()}


def spiral(side):
    """One component that winds through every block."""
    out = np.zeros((side, side), bool)
    r = c = 0
    dr, dc = 0, 1
    out[0, 0] = True
    while True:
        for _ in range(2):
            a, b = r + dr, c + dc
            ahead = (a + dr, b + dc)
            if 0 <= a < side and 0 <= b < side and not out[a, b] and not (0 <= ahead[0] < side and 0 <= ahead[1] < side and out[ahead]):
                r, c = a, b
                out[r, c] = True
                break
            dr, dc = dc, -dr
        else:
            return out


def masks():
    rng = np.random.default_rng(3)
    return {"sparse": rng.random((40, 33)) < 0.2, "dense": rng.random((40, 33)) < 0.45, "full": np.ones((25, 33), bool), "spiral": spiral(33), "corners": np.eye(33, dtype=bool) | np.eye(33, dtype=bool)[::-1], "one": np.pad([[True]], 16)}


def rows(spark, masks):
    return spark.createDataFrame([(n, int(r), int(c)) for n, m in masks.items() for r, c in zip(*np.nonzero(m))], "pair_id string, r long, c long")


@pytest.mark.parametrize("block", [9, 512])
def test_components_over_blocks(spark, block):
    given = masks()
    table = rows(spark, given)
    found = {}
    for x in change.components8(table.unionByName(table.limit(50)), 33, block).collect():
        found.setdefault(x.pair_id, {})[x.r, x.c] = (x.component, x.area)
    assert found == {n: flood(m) for n, m in given.items()}


@pytest.mark.parametrize("block", [3, 512])
def test_neighbors_over_blocks(spark, block):
    given = masks()
    found = {(x.pair_id, x.r, x.c): x.neighbors for x in change.neighbors8(rows(spark, given).withColumn("own", F.lit(1)), block).collect()}
    for name, m in given.items():
        wide = np.pad(m.astype(int), 1)
        near = sum(wide[1 + i : wide.shape[0] - 1 + i, 1 + j : wide.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)
        assert {k[1:]: v for k, v in found.items() if k[0] == name} == {(int(r), int(c)): int(near[r, c]) for r, c in zip(*np.nonzero(m))}


def test_suppression_over_many_blocks_equals_one(spark):
    sf = "/root/testdata/sf0.01"
    over = change.candidates(catalogue._raster(spark, sf), k=1.0)
    one, many = (sorted(map(tuple, change.supported(over, catalogue.WIDTH, block=b).select("pair_id", "r", "c", "neighbors", "component", "area", "confidence").collect())) for b in (512, 9))
    assert one == many and any(x[4] is not None for x in one) and any(x[4] is None for x in one)


def test_graph_of_chains_and_stars(spark):
    rng = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(0, 40)] + [(200, j) for j in range(300, 420)] + [(500, 501), (501, 500), (7, 7)] + [tuple(map(int, rng.integers(600, 640, 2))) for _ in range(30)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_kernel_of_candidates_against_flood_fill():
    rng = np.random.default_rng(5)
    for _ in range(30):
        values = rng.random((12, 15))
        got = kernels.candidates(np.arange(180), values.ravel(), 15, 0.6, 2, 4)
        mask = values > 0.6
        wide = np.pad(mask.astype(int), 1)
        near = sum(wide[1 + i : 13 + i, 1 + j : 16 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)
        want = {k: v for k, v in flood(mask & (near >= 2)).items() if v[1] >= 4}
        assert got["neighbors"].tolist() == near[mask].tolist()
        assert {(int(p) // 15, int(p) % 15): (int(c), int(a)) for p, c, a in zip(got["place"], got["component"], got["area"]) if c >= 0} == want
