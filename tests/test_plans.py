"""What the engine makes of the queries: pruned scans, no single-task windows over tables, no nested loops over tables."""

import re

import pytest

from textloom.operators import vectors
from textloom.plans import queries as core
from textloom.staging import stage

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "columns"), [("topk_docs", {"doc_id", "n_chars"}), ("canonical_url", {"page_id", "url"}), ("accuracy_rows", {"doc_id", "lang", "quality", "toxic"}), ("signature", {"doc_id", "text"})])
def test_scans_read_only_what_is_used(spark, name, columns):
    assert read_columns(plan(core.QUERIES[name](spark, FOLDER))) <= columns


def read_columns(text):
    read = re.findall(r"ReadSchema: struct<(.*?)>(?=\n|$|,? )", text)
    assert read
    return {c.split(":")[0] for r in read for c in re.split(r",(?![^<]*>)", r)}


def test_vectors_are_read_as_filters_and_columns_say_and_no_query_is_in_the_plan(spark, monkeypatch):
    staged = {}
    monkeypatch.setattr(vectors, "stage", lambda df, name, **kw: staged.setdefault(name, plan(df)) and stage(df, name, **kw))
    last = plan(core.QUERIES["vector_topk"](spark, FOLDER))
    for name in ("vector-blocks", "query-blocks"):
        assert read_columns(staged[name]) <= {"vec_id", "embedding"} and "IsNotNull(embedding)" in staged[name]
    sizes = {name: len(text) for name, text in staged.items()}
    staged.clear()
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)  # five times as many blocks, and the same plan
    again = plan(core.QUERIES["vector_topk"](spark, FOLDER))
    assert abs(len(again) - len(last)) < 0.1 * len(last)
    assert {name: n for name, n in sizes.items() if abs(len(staged[name]) - n) > 0.1 * n} == {}


@pytest.mark.parametrize("name", ["bm25_top10", "rrf_fusion", "vector_topk", "assign_ids", "neighbour_window", "context_budget", "upsert_anti", "search_dedup"])
def test_no_cartesian_products(spark, name):
    text = plan(core.QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    # a nested loop only ever takes the one row of statistics
    for own in re.findall(r"BroadcastNestedLoopJoin.*", text):
        assert own.startswith("BroadcastNestedLoopJoin BuildRight, Inner")


@pytest.mark.parametrize("name", ["clean_lines", "greedy_pack", "canonical_url", "bm25_top10", "term_frequencies", "neighbour_window", "context_budget", "html_strip", "route_boost", "search_dedup"])
def test_expressions_stay_in_the_engine(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(core.QUERIES[name](spark, FOLDER)))
