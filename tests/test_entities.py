"""The entity index against patterns that are made for each title and tried on each text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.operators import entities, multihop

HOW = entities.NamePattern()


def by_pattern(text, course):
    found = re.findall(re.escape(course) + r"\s*" + HOW.bracket, text, re.I)
    if not found and course in text:
        at = text.index(course)
        found = re.findall(HOW.bracket, text[at : at + entities.WINDOW])
    if not found:
        return None
    return [n for n in re.split(HOW.separators, found[0]) if re.fullmatch(HOW.name, n)]


@pytest.mark.parametrize("seed", range(2))
def test_names_are_those_of_patterns_tried_on_each_text(spark, seed):
    rng = random.Random(seed)
    bits = ["数据结构", "操作系统", "C++", "c++", "AI", "ai", " ", "　", "\n", "【张三】", "【李四、Wang】", "【", "】", "【x】", "【1 2】", "【赵六七,王五】", "说明" * 9, "x" * 50]
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([0, 4, 12, 30]))) for _ in range(150)]
    courses = ["数据结构", "操作系统", "C++", "AI", "说明"]
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None)], "idx long, text string")
    asked = chunks.withColumn("course", F.explode(F.array(*map(F.lit, courses))))
    got = {(r["idx"], r["course"]): r["names"] for r in entities.names_after(asked.withColumn("key", F.col("course")), entities.entity_postings(chunks, HOW), ["idx", "key"]).withColumnRenamed("key", "course").collect()}
    want = {(i, c): n for i, t in enumerate(texts) for c in courses if (n := by_pattern(t, c)) is not None}
    assert got == want and len({tuple(n) for n in want.values()}) > 3


def test_postings_and_entities(spark):
    df = spark.createDataFrame([(2**53 + 1, "课 【张三、Li】x【a【王五】"), (2, "none"), (None, "【李四】")], "idx long, text string")
    rows = entities.entity_postings(df, HOW)
    assert sorted((r["start"], r["end"], r["before"], tuple(r["names"])) for r in rows.where("idx > 5").collect()) == [(2, 9, "课", ("张三", "Li")), (10, 16, "课 【张三、Li】x", ()), (12, 16, "课 【张三、Li】x【a", ("王五",))]
    assert sorted(map(tuple, entities.entities(rows.where("idx > 5")).collect())) == [("Li", 2**53 + 1, 2, 1), ("张三", 2**53 + 1, 2, 0), ("王五", 2**53 + 1, 12, 0)]
    assert entities.entity_postings(df.limit(0), HOW).count() == 0


def test_hops_of_another_language(spark):
    hop = multihop.HopProfile(triggers=("mail",), person=r"([A-Z][a-z]+)'s", names=entities.NamePattern(bracket=r"\(([^)]{2,40})\)", separators=", *", name="[A-Z][a-z]+"), follow_up="home page", profile=("mail",))
    asked = spark.createDataFrame([(1, "mail of 《Logic》"), (2, "Ann's mail"), (3, "《Logic》")], "qid long, q string")
    found = spark.createDataFrame([(q, i + 1, i, t) for q in (1, 3) for i, t in enumerate(["logic (Bob, x, Cid)", "Logic by (Ann, Bob)"])], "qid long, ord int, idx long, text string")
    named = multihop.teacher_names(asked, found, None, hop)
    assert {r["qid"]: r["names"] for r in named.collect()} == {1: ["Bob", "Cid", "Ann"], 2: ["Ann"], 3: ["Bob", "Cid", "Ann"]}
    assert sorted(map(tuple, multihop.follow_ups(named, hop).select("qid", "nth", "followup").collect())) == [(1, 0, "Bob home page"), (1, 1, "Cid home page"), (1, 2, "Ann home page"), (2, 0, "Ann home page")]
