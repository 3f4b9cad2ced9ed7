"""Every query of the catalogue against its SQL, over the smallest tables."""

import duckdb
import pandas as pd
import pytest

from terraquarry.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def tidy(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, sf, db, name):
    got = tidy(catalogue.QUERIES[name](spark, sf).toPandas())
    want = tidy(db.execute(catalogue.ORACLE_SQL[name]).df())
    assert len(got)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6)
