"""The queries that SQL can express, against their SQL."""

import duckdb
import pytest
from conftest import plain

from textloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = [{k: plain(v) for k, v in r.asDict().items()} for r in queries.QUERIES[name](spark, FOLDER).collect()]
    cur = con.execute(queries.ORACLE_SQL[name])
    columns = [x[0] for x in cur.description]
    want = [dict(zip(columns, map(plain, r), strict=True)) for r in cur.fetchall()]
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted(got, key=key) == sorted(want, key=key)
    assert got
