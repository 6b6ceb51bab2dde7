"""Every registered query with SQL returns what DuckDB returns on the same tables."""

import os

import pytest

from rootweave.plans import catalogue

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def views():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_equals_sql(spark, views, name):
    found = catalogue.queries()[name](spark, FOLDER)
    expected = views.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(found.columns)
    assert _rows(found.columns, [tuple(r) for r in found.collect()]) == _rows(columns, expected.fetchall())
