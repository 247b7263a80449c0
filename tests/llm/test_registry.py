"""The registered queries: one for each operator, and SQL twins against DuckDB."""

import duckdb
import pytest

from tidemark.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    return None if v is None else round(float(v), 9) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


def test_one_query_per_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twin(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    key = lambda r: [str(plain(v)) for v in r]
    assert sorted(map(key, ([r[i] for i in at] for r in found.fetchall()))) == sorted(map(key, df.collect()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_all_documents_are_answered(spark, name):
    ids = {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    rows = [r["doc_id"] for r in QUERIES[name](spark, SF).collect()]
    assert set(rows) == ids and (name.startswith("op4") or len(rows) == len(ids))
