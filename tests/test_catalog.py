"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from sketchmill import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    frame, want = catalog.QUERIES[name](spark, DATA), sql.sql(catalog.ORACLES[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(tidy(r[c]) for c in columns) for r in frame.collect()), key=str)
    assert rows == sorted((tuple(tidy(r[k]) for k in at) for r in want.fetchall()), key=str)
