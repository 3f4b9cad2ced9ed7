import math

import numpy as np

from terraquarry.operators import change


def test_percentiles_of_the_valid_pixels(spark):
    values = [float(x * x) for x in range(37)]
    rows = [(1, x) for x in [*values, math.nan, math.inf, None]] + [(2, 5.0)]
    got = {r.pair_id: (r.p95, r.p99) for r in change.percentiles(spark.createDataFrame(rows, "pair_id long, magnitude double")).collect()}
    assert np.allclose(got[1], np.percentile(values, [95, 99]))
    assert got[2] == (5.0, 5.0)
