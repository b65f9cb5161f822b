"""Language identification: held-out accuracy, calibration, whole texts and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import language_id, queries

SCHEMA = "doc_id long, text string, lang string, held_out string, score int, label string, id string, part int"


def grams(text):
    """Hashes of a text's n-grams, one by one."""
    signs, out = language_id._without_keys(language_id.signs()[[ord(c) for c in text.lower()]] if text else np.zeros(0, np.uint32)), []
    line = [0]
    for s in [*signs.tolist(), 0]:
        if s or line[-1]:
            line.append(s)
    for n in range(1, language_id.LONGEST_GRAM + 1):
        for i in range(len(line) - n + 1):
            if n == 1 and not line[i]:
                continue
            h = 0
            for s in line[i : i + n]:
                h = ((h * 0x01000193 & 0xFFFFFFFF) ^ s) * 0x85EBCA6B & 0xFFFFFFFF
            out.append((h ^ h >> 15) & language_id.BUCKETS - 1)
    return sorted(out)


@pytest.mark.parametrize("piece", [1 << 20, 7, 3, 1])
def test_ngrams_of_pieces_equal_those_one_by_one(piece, monkeypatch):
    monkeypatch.setattr(language_id, "PIECE", piece)
    for text in ["", "a", "Ab c", "  ...  ", "Éa, bcd -- éf  日本語 x", "no digits but words. " * 3]:
        assert sorted(np.concatenate(list(language_id.buckets(text))).tolist()) == grams(text)


def test_keys_count_for_nothing():
    assert np.array_equal(*(np.concatenate(list(language_id.buckets(t))) for t in ("word 2abc3ff2ca8fb1 end", "word 2 end")))


def test_held_out_accuracy_and_calibration(spark):
    folder = "/root/testdata/sf0.1"
    lang = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    out = queries.op12_language_id(spark, folder)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = out.join(lang, "doc_id").collect()
    assert len(rows) == lang.count()
    held = [r for r in rows if r["held_out"]]
    right = np.array([r["lang"] == r["lang_pred"] for r in held])
    assert right.mean() > 0.995
    assert abs(right.mean() - np.mean([r["score"] for r in held])) < 0.01
    assert all(0 <= r["score"] <= 1 for r in rows)


def planted(n, seed=0):
    rng = random.Random(seed)
    say = {"xx": "abcde", "yy": "mnopq", "zz": "вгджз"}
    return [(i, " ".join("".join(rng.choices(say[k], k=5)) for _ in range(12)), k) for i in range(n) for k in [rng.choice(list(say))]]


def table(spark, rows):
    return spark.createDataFrame([(*r, "h", 1, "l", "i", 2) for r in rows], SCHEMA).repartition(3)


def test_odd_rows(spark):
    rows = planted(300)
    big = 2**53 + 1
    odd = [(big, None, "xx"), (big + 2, "", "yy"), (None, rows[0][1], "xx"), (400, "12 ... !", "zz"), (401, rows[0][1], None), (401, rows[0][1], None), (402, rows[1][1] * 3000, None), (403, "é", None)]
    model = language_id.train(table(spark, rows + odd))
    got = language_id.predict(table(spark, rows + odd), model).collect()
    lang = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == len(rows + odd) and lang[big] == lang[big + 2] == lang[400] == "und"
    assert lang[None] == lang[401] == rows[0][2] and lang[402] == rows[1][2] and lang[403] in model.names
    assert all(lang[i] == k for i, _, k in rows)
    assert [r["score"] for r in got if r["doc_id"] == big] == [0.0]
    assert (model.weights == 0).any()  # by the penalty on absolute values


def test_no_labels_and_no_rows(spark):
    for rows in ([], [(1, "some text", None)]):
        df = table(spark, rows)
        got = language_id.predict(df, language_id.train(df)).collect()
        assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * len(rows)


def test_only_learnable_rows_are_sampled_and_languages_are_bounded(spark):
    rows = planted(2000) + [(5000 + i, "q r s", "rare") for i in range(40)]
    df = table(spark, rows)
    some = language_id.sample(df, per_language=50)
    n = {r["lang"]: r["count"] for r in some.groupBy("lang").count().collect()}
    assert n.pop("rare") > 20 and set(n.values()) == {50}
    assert some.where(language_id.held_out()).isEmpty()
    assert df.where(language_id.held_out()).count() > 300
    least = df.where(~language_id.held_out() & (F.col("lang") == "xx")).orderBy(F.xxhash64("doc_id")).limit(50)
    assert {r[0] for r in some.where("lang = 'xx'").select("doc_id").collect()} == {r[0] for r in least.select("doc_id").collect()}
