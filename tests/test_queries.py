"""Every core query against its SQL twin, and the entry point."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 9) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert got
        return
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    want = [tuple(r[i] for i in at) for r in found.fetchall()]
    key = lambda r: [str(plain(v)) for v in r]
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_entry(spark):
    assert entry.entry(spark).count() == 4599
    assert set(entry.oracle_sql()) <= set(entry.queries())
