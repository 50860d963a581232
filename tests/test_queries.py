"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessera import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    try:
        return f"{float(value):.6g}" if not isinstance(value, str) else value
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in got.collect())
    result = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(str([plain(r[i]) for i in order]) for r in result.fetchall())


def test_without_sql(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLES)):
        assert catalog.QUERIES[name](spark, DATA).columns
