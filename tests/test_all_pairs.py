from itertools import combinations

from terraquarry.plans import catalogue


def test_every_pair_however_far_apart(spark, sf):
    by_customer = {}
    for r in spark.read.parquet(f"{sf}/orders.parquet").collect():
        by_customer.setdefault(r.o_custkey, []).append((r.o_orderdate, r.o_orderkey))
    want = sorted((a[1], b[1]) for own in by_customer.values() for a, b in combinations(sorted(own), 2) if a[0] < b[0])
    got = sorted((r.reference_id, r.comparison_id) for r in catalogue.QUERIES["all_pairs"](spark, sf).collect())
    assert got == want
    near = {(r.reference_id, r.comparison_id) for r in catalogue.QUERIES["all_pairs_90_days"](spark, sf).collect()}
    assert near < set(got)
