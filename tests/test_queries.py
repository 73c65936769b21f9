"""Every query against its SQL, and none without a result schema."""

import duckdb
import pytest

import __spark_entry__ as driver
from millrace import oracle
from millrace import queries as flow

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns: list[str], found: list[tuple]) -> list[tuple]:
    def plain(x):
        return "null" if x is None else f"{x:.10g}" if isinstance(x, float) else str(x)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = flow.QUERIES[name](spark, SF), duck.sql(oracle.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(flow.QUERIES) == set(oracle.ORACLE_SQL)


def test_entry_and_registration(spark):
    assert driver.entry(spark).count() > 0
    assert set(flow.QUERIES) <= set(driver.queries())
    assert set(oracle.ORACLE_SQL) <= set(driver.oracle_sql()) <= set(driver.queries())
