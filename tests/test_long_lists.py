"""Deduplication of long lists by rounds against the fold."""

import random

import pytest

from textloom.operators import fusion

SCHEMA = "qid long, ord long, idx long, url string, text string"


def kept(df):
    return sorted((r["qid"], r["ord"]) for r in df.collect())


@pytest.mark.parametrize("keys", [3, 40])
def test_rounds_equal_the_fold(spark, keys):
    rng = random.Random(keys)
    rows = [(2**53 + q, o, o, rng.choice([None, "", *(f"u{rng.randrange(keys)}" for _ in range(9))]), rng.choice([None, "", *(f"t {rng.randrange(keys)}" for _ in range(12))])) for q in range(3) for o in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = fusion.dedup_long_lists(df, canonical=False)
    assert got.columns == df.columns
    assert kept(got) == kept(fusion.dedup_candidates(df, canonical=False))


def test_a_chain_and_a_frequent_key(spark):
    chain = [(0, i, i, f"u{i // 2}", f"t{(i + 1) // 2}") for i in range(12)]  # each row excludes the next
    hot = [(1, i, i, "u", f"t{i}") for i in range(500)] + [(1, 500 + i, i, f"v{i}", "t7") for i in range(500)]
    df = spark.createDataFrame(chain + hot, SCHEMA)
    assert kept(fusion.dedup_long_lists(df, canonical=False)) == [*((0, i) for i in range(0, 12, 2)), (1, 0), (1, 500)]


def test_an_empty_list(spark):
    assert fusion.dedup_long_lists(spark.createDataFrame([], SCHEMA)).count() == 0
