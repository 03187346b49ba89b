"""Every registered query with SQL gives the rows that DuckDB gives on the smallest tables."""

import duckdb
import pytest

from freightlake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert {c: KINDS.get(k, k) for c, k in got.dtypes} == dict(zip(want.columns, map(str, want.types)))
    order = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
