"""The pipeline's near-duplicate stage against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest

from textloom.llm import near_copies, simhash


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b) > 0


def staying(rows):
    """(doc_id, text) pairs that stay, of pairs with distinct (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and near(sets[i], sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return {(min(rows[j][0] for j in range(len(rows)) if group[j] == g)) for g in set(group)}


def edited(rng, base, edits):
    out = list(base)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"x{rng.random()}"
    return out


def documents():
    rng, texts = random.Random(11), [None, "", " \n", "one", "ONE", "two words"]
    for _ in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 300))]
        texts.append(" ".join(base))
        for edits in (1, 2, 4, 8):
            texts.append(" ".join(edited(rng, base, edits)))
    base = [f"v{i}" for i in range(200)]
    texts += [" ".join(edited(rng, base, 2)) for _ in range(60)]  # one large group of near copies
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("part", [2048, 7])
def test_one_of_each_group_of_edited_copies_stays(spark, monkeypatch, part):
    monkeypatch.setattr(near_copies, "PART_TEXTS", part)
    rows = documents()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    kept = corpus_pipeline.one_of_near_duplicates(spark, df, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(staying(rows))
    assert len(staying(rows)) < len(rows) - 100


def test_similarity_is_exact_at_the_bound():
    a = np.arange(9, dtype=np.uint64)
    assert near_copies.similar([a, np.r_[a[:8], np.uint64(20)]]).tolist() == [0, 0]  # 8 of 10
    assert near_copies.similar([a[:7], np.r_[a[:6], np.uint64(20)]]).tolist() == [0, 1]  # 6 of 8


def test_shared_bands_find_pairs_at_the_bound():
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(300):
        own = np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64))
        a, b = near_copies.bands([own[:90], own[10:]])  # 80 of 100
        missed += not (a == b).any()
    assert missed <= 1


@pytest.mark.parametrize("size", [10, 50, 1000])
def test_the_radius_reaches_pairs_at_the_bound(size):
    rng = np.random.default_rng(size)
    apart = []
    for _ in range(400):
        own = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64)) * near_copies.STEP
        tenth = size // 10
        a, b = simhash.majority([own[:-tenth], own[tenth:]])  # similarity 0.8
        apart.append(int(a ^ b).bit_count())
    assert max(apart) <= near_copies.RADIUS and np.mean(apart) > 6


def test_empty_table(spark):
    assert near_copies.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_repeated_doc_id_does_not_lose_a_distinct_text(spark):
    rows = [(1, "a b c d e f", 1), (2, "A b c d e f", 1), (2, "quite another text stands here", 1), (3, "third", 2), (3, "third", 1), (4, "fourth", 1), (4, "FOURTH", 1), (None, "a b c d e f", 1)]
    kept = [tuple(r) for r in near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)).collect()]
    again = [tuple(r) for r in near_copies.one_of_each(spark.createDataFrame(rows[::-1], "doc_id long, text string, n int").repartition(5)).collect()]
    assert sorted(kept, key=str) == sorted(again, key=str)
    assert {r[:2] for r in kept} >= {(1, rows[0][1]), (2, rows[2][1]), (None, rows[0][1])}
    assert [r[0] for r in sorted(kept, key=str)] == [1, 2, 3, 4, None]


def test_distinct_texts_of_many_repeated_doc_ids_stay(spark):
    own = [(i, f"text {i} of its own {i * i} {i * 7}") for i in range(2, 14)]
    pairs = [p for t in own for p in ((t, (t[0], "a b c d e f")) if t[0] % 2 else ((t[0], "a b c d e f"), t))]
    kept = near_copies.one_of_each(spark.createDataFrame([(1, "a b c d e f"), *pairs], "doc_id long, text string").coalesce(1))
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c d e f"), *own]


def test_clashing_columns_and_rows_without_id(spark):
    rows = [(1, "a b c d e", 9), (2, "A b c d e", 9), (2, "A b c d e", 9), (3, "other words stand here", 9), (3, "other words stand here", 9), (None, "a b c d e", 9), (4, None, None)]
    kept = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _digest int"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c d e", 9), (3, "other words stand here", 9), (None, "a b c d e", 9), (4, None, None)], key=str)
    assert kept.columns == ["doc_id", "text", "_digest"]
