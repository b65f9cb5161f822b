"""Collocations against a version by hand."""

import collections
import random
import re

import pytest

from textloom.llm import phrases

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, block string, n string, phrase string, id int"


def by_hand(rows, longest=5, least=100, top=2000):
    f, n, out = collections.defaultdict(collections.Counter), collections.Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k] for p, a in some.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * c[p[i : i + k]]}
        found = []
        for p in some.keys() - inside:
            score, k = min((1000 * some[p] * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -some[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(i, *r, "b", "n", "p", 1) for i, r in enumerate(rows)], SCHEMA).repartition(4)
    return sorted(map(tuple, phrases.collocations(df, **how).collect()))


@pytest.mark.parametrize(("seed", "block"), [(0, 4 << 20), (1, 300)])
def test_phrases_equal_version_by_hand(spark, seed, block, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", block)
    rng = random.Random(seed)
    words = ["a", "A", "b", "the", "of", "É", "é", "日本", "x y", "\x1c", "c-d", " "]
    marks = [" ", " ", " ", " ", "  ", "\t", ".", ", ", "!\n", "\r\n", "\x0b", ";"]
    texts = ["".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.choice([0, 3, 50, 400]))) for _ in range(60)]
    rows = [(t, rng.choice(["en", "de", None, ""])) for t in texts] + [(None, "en"), ("", None), (texts[3], "en"), (texts[3], "en"), ("to be or not " * 900, "zz")]
    blocks = phrases.word_blocks(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").coalesce(1))
    assert blocks.count() > 40 if block < 1000 else blocks.count() == 5
    assert mined(spark, rows, least=12) == by_hand(rows, least=12)
    assert mined(spark, rows, least=12, top=3, longest=3) == by_hand(rows, least=12, top=3, longest=3)


def test_blocks_are_cut_at_marks_only():
    text = "a b c. d e, f g h i j k; l".encode().translate(phrases.PLAIN)
    parts = list(phrases._pieces(text, 6))
    assert b"".join(parts) == text and all(p.startswith(b".") for p in parts[1:]) and len(parts) > 2
    assert list(phrases._pieces(b"x " * 50, 10)) == [b"x " * 50]
    rows = [phrases._block("en", [p], i) for i, p in enumerate(parts)]
    assert sum(r.column(2)[0].as_py() for r in rows) == 12


def test_pairs_that_fill_all_counters_change_nothing(spark, monkeypatch):
    rows = [("p q r s t " * 40, "en"), ("q r p t s " * 30, "en")]
    want = by_hand(rows, least=20)
    monkeypatch.setattr(phrases, "possible", lambda counted, least: __import__("numpy").ones(phrases.BUCKETS, dtype=bool))
    assert mined(spark, rows, least=20) == want


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000_000
    df = spark.createDataFrame([(big, 9 * big, [big + 1, big], [big + 2, big])], "f long, n long, firsts array<long>, lasts array<long>")
    got = df.select(phrases.best_cut(2).alias("x")).select("x.*").first()
    assert tuple(got) == (1000 * big * 9 * big // ((big + 1) * (big + 2)), 1, big + 1, big + 2)


def test_no_documents(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None)]) == []


def test_rows_do_not_grow_with_blocks(spark, monkeypatch):
    """What is joined, staged and summed up is phrases, not the words and pairs of each block."""
    made = {}

    def counted(df, name, **how):
        out = staged(df, name, **how)
        made[name] = out.count()
        return out

    staged = phrases.stage
    monkeypatch.setattr(phrases, "stage", counted)
    monkeypatch.setattr(phrases, "BLOCK", 300)
    text = "p q r s t u v w x y. " * 20
    few = mined(spark, [(text, "en")] * 40, least=100)
    blocks, rows = made.pop("words"), sum(made.values())
    many = mined(spark, [(text, "en")] * 320, least=100)
    assert made.pop("words") > 6 * blocks > 100
    assert sum(made.values()) == rows and [x[2] for x in many] == [x[2] for x in few]


def test_blocks_of_many_words(spark):
    """A block with more distinct words than two bytes count."""
    rows = [(" ".join(f"w{i}" for i in range(70_000)) + ". " + "w69998 w69999 " * 30, "en")]
    assert mined(spark, rows, least=20) == by_hand(rows, least=20)
