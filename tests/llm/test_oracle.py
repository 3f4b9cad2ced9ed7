import duckdb
import pytest

from terraquarry.llm import queries


def view(con, sf, name):
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_their_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        view(con, sf, table)
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf).select(*want.columns)
    assert sorted(got.columns) == sorted(queries.QUERIES[name](spark, sf).columns)
    rows = sorted(map(tuple, got.collect()))
    assert rows and rows == sorted(want.fetchall())
