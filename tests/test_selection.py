"""Exact quantiles against NumPy, of groups over the limit and under it."""

import math

import numpy as np
from pyspark.sql import functions as F

from terraquarry.operators import selection

SHARES = [0.0, 0.01, 0.25, 0.5, 0.73, 0.99, 1.0]


def groups():
    rng = np.random.default_rng(4)
    return {
        "normal": rng.normal(0, 1, 3000), "powers": np.concatenate((10.0 ** rng.uniform(-300, 300, 2000), -(10.0 ** rng.uniform(-300, 300, 1500)), np.zeros(40))),
        "ties": rng.integers(0, 3, 2500).astype(float), "one": np.full(900, 7.25), "narrow": 1e9 + rng.random(2500) * 1e-6, "tiny": np.array([3.0]), "few": rng.random(40),
        "extremes": np.concatenate((rng.choice([np.finfo(float).max, -np.finfo(float).max, 5e-324, -5e-324, 0.0], 1200), rng.random(300))), "even": np.arange(1000.0),
    }


def test_quantiles_of_any_distribution(spark):
    given = groups()
    rows = [(n, float(x)) for n, v in given.items() for x in v] + [("normal", math.nan), ("normal", math.inf), ("normal", None), ("none", None), (None, 1.0), (None, 2.0)]
    table = spark.createDataFrame(rows, "name string, x double").repartition(4)
    for limit in (100, 10**6):
        found = {r.name: r.q for r in selection.quantiles(table, ["name"], F.col("x"), SHARES, limit).collect()}
        assert found.keys() == {*given, "none", None} and found["none"] is None and found[None][3] == 1.5
        for name, v in given.items():
            v = np.sort(v)
            for share, got in zip(SHARES, found[name]):
                place = (len(v) - 1) * share
                low, high, part = v[math.floor(place)], v[math.ceil(place)], place - math.floor(place)
                want = low if part == 0 else (1 - part) * low + part * high
                assert got == want or abs(got - want) <= max(1e-12 * max(abs(low), abs(high)), 1e-320), (name, share)


def test_no_buffer_holds_more_than_the_limit(spark):
    """400,000 different values in one group, four counts a bin at most on the way: the ranks are those of the sorted values."""
    table = spark.range(400_000).selectExpr("1 AS k", "CAST((id * 7919) % 400000 AS DOUBLE) / 3 AS x")
    (row,) = selection.quantiles(table, ["k"], F.col("x"), [0.5, 0.999], limit=50).collect()
    assert np.allclose(row.q, [399_999 / 6, 399_999 * 0.999 / 3], rtol=1e-12)
