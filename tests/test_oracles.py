"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from marlstone.plans import queries as research

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return str(x)
    return f"{x + 0:.7g}"


def _rows(table, columns):
    return sorted(tuple(map(_cell, row)) for row in zip(*[table[c].to_pylist() for c in columns]))


@pytest.mark.parametrize("name", sorted(research.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = research.QUERIES[name](spark, SF).toArrow()
    want = duck.sql(research.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert _rows(got, sorted(got.column_names)) == _rows(want, sorted(got.column_names))


@pytest.mark.parametrize("name", sorted(set(research.QUERIES) - set(research.ORACLE_SQL)))
def test_runs(spark, name):
    assert research.QUERIES[name](spark, SF).count() > 0


def test_entry_file():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(research.QUERIES) <= set(__spark_entry__.queries())
