"""Rules by one scan against containment term by term."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import rules as R
from textloom.operators import term_rules as T


def holds(rule, fields):
    inside = lambda clause: any(t in T.START + (fields[clause[0]] or "") + T.END for t in clause[1])
    return all(map(inside, rule.clauses)) and not any(map(inside, rule.excluded))


def test_a_thousand_rules_equal_containment(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab.\\中😀]^-") for _ in range(rng.randrange(1, 5)))
    clause = lambda: (rng.choice("xy"), tuple(word() for _ in range(rng.randrange(1, 4))))
    rules = [T.TermRule(f"r{i // 2}", tuple(clause() for _ in range(rng.randrange(1, 4))), tuple(clause() for _ in range(rng.randrange(2)))) for i in range(1000)]
    rows = [(i, "".join(word() for _ in range(rng.randrange(8))), rng.choice([None, "", word() + word()])) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, x string, y string")
    compiled = T.TermRules(rules)
    got = compiled.hits(df, "id", {"x": F.col("x"), "y": F.col("y")})
    want = {(i, r.name) for i, x, y in rows for r in rules if holds(r, {"x": x, "y": y})}
    found = [tuple(r) for r in got.collect()]
    assert set(found) == want and len(found) == len(want) > 1000
    few = T.TermRules(rules[:10]).hits(df, "id", {"x": F.col("x"), "y": F.col("y")})
    count = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert count(got) == count(few)


def test_a_large_table_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(T, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(1, "ab"), (1, "cd"), (2, "ab"), (None, "abcd")], "id long, x string")
    got = T.TermRules([T.TermRule("both", (("x", ("ab",)), ("x", ("cd",))))]).hits(df, "id", {"x": F.col("x")})
    assert sorted(got.collect(), key=str) == [(1, "both"), (None, "both")]


def test_rules_without_terms_raise(spark):
    for rule in (T.TermRule("a", ()), T.TermRule("a", (("x", ()),)), T.TermRule("a", (("x", ("",)),))):
        with pytest.raises(ValueError):
            T.TermRules([rule])
    assert T.TermRules([]).hits(spark.range(3), "id", {}).count() == 0


def test_a_sites_boosts_equal_those_of_its_columns(spark):
    site = R.SiteProfile()
    rng = random.Random(1)
    boosts = R.boosts(site)
    asked = sorted({t for b in boosts for t in (*b.trigger.any, *b.trigger.all, *b.trigger.none)} | {*R.FOUNDING, *R.EXACT_URL, *R.EXACT_URL_BOTH, *R.EXACT_URL_NOT})
    terms = sorted({t for b in boosts for c, _ in b.steps for _, ts in c for t in ts})
    some = lambda words, n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    questions = [(i, some(asked, 5)) for i in range(40)] + [(40, None), (41, "")]
    chunks = [(i, rng.choice([None, "About", "学院介绍", some(terms, 3)]), rng.choice([None, "https://A.example.edu/2825/list.htm", "/school_en/x"]), some([*terms, "TITLE", "x"], 6)) for i in range(40)]
    q, c = spark.createDataFrame(questions, "qid long, q string"), spark.createDataFrame(chunks, "idx long, title string, url string, text string")
    pairs = [(i, j) for i in range(42) for j in range(40)]
    table = T.BoostTable(boosts)
    got = table.scores(spark.createDataFrame(pairs, "qid long, idx long"), table.asked(q), table.held(c))
    by_columns = R.RuleSet(site)
    met = spark.createDataFrame(pairs, "qid long, idx long").join(q, "qid").join(c, "idx").where("q is not null")
    want = met.select("qid", "idx", F.round(by_columns.route_boost(F.col("q"), F.col("title"), F.col("url"), F.col("text")), 9).alias("b"), R.is_time_query(F.col("q")).alias("time"))
    want = {(r["qid"], r["idx"]): r["b"] for r in want.collect() if not r["time"]}  # dates are no rule by containment
    rows = {(r["qid"], r["idx"]): round(r["boost"], 9) for r in got.collect()}
    assert len(rows) == len(pairs)
    assert {k: rows[k] for k in want} == want
    assert len({v for v in want.values()}) > 10
