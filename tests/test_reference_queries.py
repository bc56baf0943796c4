"""Every query with SQL gives the same rows in DuckDB, at the smallest size."""

import os
from collections import Counter

import duckdb
import pytest

from sparkloom import registry

DATA = "/root/testdata/sf0.001"
TABLES = "documents conversations events labels".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")
@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.SQL])
def test_same_as_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(columns).collect())
    found = con.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall())
    assert got == want
