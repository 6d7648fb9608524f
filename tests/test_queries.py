"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from gleaner import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float):
        return repr(round(x, 9) + 0.0)
    return str(x) if not isinstance(x, bool) else repr(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(value(r[k]) for k in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    got = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in got]) == rows(want.columns, want.fetchall())
