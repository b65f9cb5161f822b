"""Block maxima: the same documents as when all are scored, of fewer blocks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import bm25


def corpus(spark, seed, n=3000):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    # words cluster by range of ids, as they do in a crawl; one word is in all documents
    rows = [(i * 3, ["all"] * rng.choice([1, 1, 2]) + [rng.choice(words[(i // 300) % 10 * 4 :][:6] if rng.random() < 0.9 else words) for _ in range(rng.choice([0, 3, 10, 60]))]) for i in range(n)]
    return spark.createDataFrame([*rows, (2**53 + 1, ["w1", "all"]), (9 * n, []), (9 * n + 1, None)], "doc_id long, tokens array<string>").repartition(4)


def exhaustive(index, queries, n, **how):
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "first", "doc_id")
    rows = index.scores(queries, **how).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return sorted(map(tuple, rows.select("qid", "doc_id", "score", "rank").collect()))


@pytest.mark.parametrize(("seed", "n"), [(0, 5), (1, 40), (2, 700)])
def test_best_equal_those_of_all(spark, seed, n, tmp_path):
    index = bm25.BM25Index.build(corpus(spark, seed))
    queries = spark.createDataFrame([(1, ["w1", "w5"]), (2, ["all"]), (3, ["w9", "w9", "all", "nowhere"]), (4, ["nowhere"]), (5, [])], "qid long, tokens array<string>")
    want = exhaustive(index, queries, n, digits=9)
    found, blocks = index.top_blocks(queries, n, digits=9)
    assert sorted(map(tuple, found.select("qid", "doc_id", "score", "rank").collect())) == want
    seen = {(r["qid"], r["scored"]): r["count"] for r in blocks.groupBy("qid", "scored").count().collect()}
    if n <= 40:  # most blocks of the first question can't reach its best
        assert seen[1, False] > seen[1, True]
    assert (4, True) not in seen and (5, True) not in seen
    index.write(str(tmp_path / "index"))
    written = bm25.BM25Index.read(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, written.top_n(queries, n, digits=9).select("qid", "doc_id", "score", "rank").collect())) == want
    other = {"k1": 1.2, "b": 0.3, "digits": 9}
    assert sorted(map(tuple, written.top_n(queries, n, **other).select("qid", "doc_id", "score", "rank").collect())) == exhaustive(index, queries, n, **other)


def test_postings_of_a_common_word_go_over_many_partitions(spark, tmp_path):
    index = bm25.BM25Index.build(corpus(spark, 3))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for key, value in (("spark.sql.shuffle.partitions", "24"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):  # so small parts would be merged
        spark.conf.set(key, value)
    index.write(str(tmp_path / "index"))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    written = bm25.BM25Index.read(spark, str(tmp_path / "index"))
    files = written.postings.where("term = 'all'").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and max(r["count"] for r in files) < sum(r["count"] for r in files)
    most = written.maxima.where("term = 'all'")
    assert most.count() > 40 and most.agg(F.sum("n")).first()[0] == 3001


def test_no_documents_and_no_queries(spark):
    index = bm25.BM25Index.build(corpus(spark, 0, 10))
    none = spark.createDataFrame([], "qid long, tokens array<string>")
    assert index.top_n(none, 5).count() == 0
    empty = bm25.BM25Index.build(spark.createDataFrame([], "doc_id long, tokens array<string>"))
    assert empty.top_n(spark.createDataFrame([(1, ["a"])], "qid long, tokens array<string>"), 5).count() == 0
