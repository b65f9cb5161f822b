"""Segmentation against all paths."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import lattice, tokens
from textloom.plans import queries


def all_paths(run):
    if not run:
        yield []
    for i in range(1, len(run) + 1):
        yield from ([run[:i], *rest] for rest in all_paths(run[i:]))


@pytest.mark.parametrize("seed", range(20))
def test_path_is_the_cheapest_of_all(seed):
    rng = random.Random(seed)
    counts = {"".join(rng.choices("abc", k=rng.choice([1, 2, 2, 3, 4]))): rng.choice([1, 3, 10, 500]) for _ in range(15)}
    known, total = lattice.Lattice(counts), sum(counts.values())
    for _ in range(10):
        run = "".join(rng.choices("abcd", k=rng.choice([0, 1, 5, 11])))
        price = lambda p: sum(-math.log((counts[w] if w in counts else lattice.UNSEEN) / total) for w in p)
        fit = [p for p in all_paths(run) if all(w in counts or len(w) == 1 for w in p)]
        got = known.path(run)
        assert "".join(got) == run and got in fit and price(got) == pytest.approx(min(map(price, fit)))


def test_equally_cheap_paths_take_the_longer_word_first():
    known = lattice.Lattice({"ab": 10, "c": 10, "a": 10, "bc": 10})
    assert known.path("abc") == ["ab", "c"] and lattice.Lattice({}).path("xy") == ["x", "y"] and known.path("") == []


def test_words_are_learned_and_inner_words_come_along(spark):
    rows = [("研究生",)] * 9 + [("研究",)] * 30 + [("生命",)] * 20 + [("命",)] * 3 + [("起源",)] * 9 + [("一次",), (None,), ("x" * 99,)] + [("信息学院院长",)] * 4 + [("学院",)] * 6 + [("学院院",)] * 2
    known = lattice.Lattice.learn(spark.createDataFrame(rows, "word string"))
    assert known.counts["研究"] == 30 and "一次" not in known.counts and "x" * 99 not in known.counts
    assert len(lattice.Lattice.learn(spark.createDataFrame(rows, "word string"), most=3).counts) == 3
    df = spark.createDataFrame([("研究生命起源 and 信息学院院长",), (None,), ("none",)], "t string")
    cut = known.segmenter()
    # longest match would take 研究生 first
    assert [r["x"] for r in df.select(known.segmenter(search=False)(F.col("t")).alias("x")).collect()] == [["研究", "生命", "起源", "信息学院院长"], [], []]
    assert df.select(cut(F.col("t")).alias("x")).first()["x"] == ["研究", "生命", "起源", "学院", "学院院", "信息学院院长"]
    assert "生命" in df.select(tokens.tokenize("t", cut).alias("x")).first()["x"]


def test_spaces_are_found_again(spark):
    rows = queries.QUERIES["segment_unspaced"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200
    near = [abs(r["n_found"] - r["n_words"]) <= 0.3 * r["n_words"] for r in rows if r["n_words"] > 20]
    assert sum(near) > 0.7 * len(near)  # most words of so small a corpus occur once


def test_a_batch_is_segmented_in_slices(spark, monkeypatch):
    import pandas as pd

    texts = pd.Series(["x" * n for n in (5, 5, 300_000, 1)] + [None, "y"])
    parts = list(lattice.slices(texts))
    assert [len(p) for p in parts] == [3, 3] and pd.concat(parts).tolist() == texts.tolist() and not list(lattice.slices(texts[:0]))
    known = lattice.Lattice({"ab": 3, "abcde": 2, "q": 2})
    assert {w for w, c in known.cost.items() if c is None} == {"a", "abc", "abcd"}  # one table for words and beginnings
    df = spark.createDataFrame([(i, "ab" * (i % 3)) for i in range(50)], "i int, t string").coalesce(1)
    monkeypatch.setattr(lattice, "SLICE", 7)
    cut = df.select("i", known.segmenter(r"\w+", search=False)(F.col("t")).alias("x")).collect()
    assert [(r["i"], r["x"]) for r in cut] == [(i, ["ab"] * (i % 3)) for i in range(50)]


def test_runs_side_by_side_have_the_paths_of_each(spark, monkeypatch):
    rng = random.Random(5)
    words = {"".join(rng.choices("abcé中", k=rng.choice([1, 2, 3, 5, 9]))): rng.choice([1, 2, 2, 7, 400]) for _ in range(60)} | {"a\0b": 9}
    runs = ["".join(rng.choices("abcé中x\0", k=n)) for n in [0, 1, 1, 2, 3, 700, 650, 30] + [rng.randrange(60) for _ in range(40)]] + ["", "ab" * 900]
    walked = []
    monkeypatch.setattr(lattice.Lattice, "_walk", lambda self, run, tail, _walk=lattice.Lattice._walk: (walked.append(len(run) - len(tail) + 1), _walk(self, run, tail))[1])
    for counts in (words, {}, {"zz": 3}):
        known = lattice.Lattice(counts)
        want = [known.path(r) for r in runs]
        for cells in (1, 500, 1 << 20):
            monkeypatch.setattr(lattice, "CELLS", cells)
            walked.clear()
            assert [lattice.cut_at(r, s.tolist()) for r, s in zip(runs, known.paths(runs), strict=True)] == want
            assert sum(walked) < sum(map(len, runs)) and len(walked) < lattice.NARROW  # letter by letter only what few runs are left with
    assert known.paths([]) == [] and [s.tolist() for s in known.paths(["zzz"])] == [known._walk("zzz", [0.0])]
    monkeypatch.setattr(lattice, "GROUP", 300)
    df = spark.createDataFrame([(i, r.replace("\0", " ")) for i, r in enumerate(runs)] + [(99, None)], "i int, t string").coalesce(1)
    known = lattice.Lattice({w: n for w, n in words.items() if "\0" not in w})
    got = {r["i"]: r["x"] for r in df.select("i", known.segmenter(r"\w+", search=False)(F.col("t")).alias("x")).collect()}
    assert got == {i: [w for part in r.split("\0") for w in known.path(part)] for i, r in enumerate(runs)} | {99: []}
