"""Ids beyond 2^53, and rows without id among them, in every operator that returns ids."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import bpe_tree, packing, secret_scan, simhash, token_counts, topk_search, vector_join, warc

BIG = 2**53 + 1
IDS = [BIG, BIG + 2, None, BIG + 4, 5]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in zip(IDS, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


TEXTS = [f"some words {w} of this text and no more" for w in ("one", "two", "three", "four", "five")]


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.select(column).collect()), key=lambda x: (x is not None, x))


WANT = sorted(IDS, key=lambda x: (x is not None, x))


@pytest.mark.parametrize("run", [
    lambda df: token_counts.count_tokens(df, public_tokenizers.path("word_bpe_49k.json")),
    lambda df: bpe_tree.encode_digests(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
    lambda df: packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json")),
    lambda df: secret_scan.digest(secret_scan.scan(df)), simhash.near_duplicates,
])
def test_documents_keep_their_ids(spark, run):
    assert ids(run(documents(spark, TEXTS))) == WANT


def test_pipeline_stages_keep_ids(spark):
    df = documents(spark, TEXTS)
    for name, step in corpus_pipeline.STAGES[1:]:
        assert ids(step(spark, df, None)) == WANT, name


def test_revisits_refer_to_ids_beyond_2_53(spark):
    rows = [(i, f"https://a.b/{n}", "<p>same</p>") for n, i in enumerate(IDS)] + [(BIG + 6, "https://a.b/x", "<p>other</p>"), (BIG + 8, "https://a.b/y", "<p>other</p>")]
    got = {r["page_id"]: r["refers_to"] for r in warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got == {5: None, None: None, BIG: 5, BIG + 2: 5, BIG + 4: 5, BIG + 6: None, BIG + 8: BIG + 6}


def test_vectors_keep_their_ids(spark):
    v = np.random.default_rng(0).normal(size=(5, 4))
    v[1] = v[0] * 2
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(IDS, v, strict=True)], "vec_id long, embedding array<double>").coalesce(1)
    near = {r["vec_id"]: r["component_id"] for r in vector_join.near_vectors(df).collect()}
    assert near[BIG + 2] == BIG and set(near) == set(IDS)
    found = topk_search.top_k(df, F.col("vec_id") == BIG, k=9).collect()
    assert sorted(r["vec_id"] for r in found) == sorted([BIG + 2, BIG + 4, 5]) and {r["query_id"] for r in found} == {BIG}


def test_scores_that_may_pass_64_bits_raise(spark):
    df = spark.createDataFrame([(0, [1e19]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        topk_search.top_k(df, F.col("vec_id") == 0)


def test_fingerprints_link_through_rows_without_id(spark, monkeypatch):
    rows = [(BIG, 0), (BIG + 2, 1), (None, 3), (6, 7), (None, 127 << 30), (None, 127 << 30), (None, -1), (3, -8), (None, 255 << 50), (2, 255 << 50 | 6)]
    monkeypatch.setattr(simhash, "fingerprints", lambda df: df.select("doc_id", "fp"))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long").coalesce(1)).collect()
    want = {0: 6, 1: 6, 3: 6, 7: 6, 127 << 30: None, -1: None, -8: 3, 255 << 50: 2, 255 << 50 | 6: 2}
    assert sorted((str(r["doc_id"]), r["fp"], str(r["component_id"])) for r in got) == sorted((str(i), fp, str(want[fp])) for i, fp in rows)
