"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest
from conftest import plain

import __spark_entry__ as entry
from textloom.plans import queries as core

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = [{k: plain(v) for k, v in r.asDict().items()} for r in core.QUERIES[name](spark, FOLDER).collect()]
    cur = duck.execute(core.ORACLE_SQL[name])
    columns = [x[0] for x in cur.description]
    want = [dict(zip(columns, map(plain, r), strict=True)) for r in cur.fetchall()]
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted(got, key=key) == sorted(want, key=key)
    assert got


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_other_queries_give_rows(spark, name):
    assert core.QUERIES[name](spark, FOLDER).count()


def test_entry_gives_the_flagship_rows(spark):
    assert entry.entry(spark).count() == 30


def test_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_chunks_of_long_documents_have_numbers_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(core.chunk, "chunk_text", lambda c: core.F.split(c, " "))
    docs = spark.createDataFrame([(0, "w " * 5000 + "w", "s", "en"), (1, "x y", "s", "en")], "doc_id long, text string, source string, lang string")
    got = [r["chunk_id"] for r in core.document_chunks(docs).orderBy("idx").collect()]
    assert got == [f"0-{i}" for i in range(5001)] + ["1-0", "1-1"]
    assert core.document_chunks(docs).select("idx").distinct().count() == 5003
