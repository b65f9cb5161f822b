"""Second hop: follow-up questions for people that a first answer names, and score adjustments for course questions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.columns import contains_any, text
from textloom.functions.text import haystack
from textloom.operators import entities
from textloom.operators.entities import NamePattern
from textloom.operators.rules import course_titles

# When a second hop is taken, how a teacher is named, what a follow-up asks, and the scores.
SECOND_HOP = ["邮箱", "研究方向", "导师", "老师", "招收"]
TEACHER = r"([一-鿿]{2,4})老师"
FOLLOW_UP = "邮箱 研究方向 中文信息 英文信息 教师主页 个人主页 师资 常任教授 招生入口"
PROFILE = ["邮箱", "e-mail", "research area", "研究方向", "招生入口", "中文信息", "英文信息"]
DENSE_SHARE, BM25_SHARE, FOUND, PROFILE_FOUND, EVIDENCE = 0.08, 0.12, 0.08, 0.28, 0.85
COURSE_HIT, TEACHER_HIT, NO_HIT = 0.22, 0.25, -0.35
CANDIDATES, NAMES = 20, 6


@dataclass(frozen=True)
class HopProfile:
    """When a second hop is taken, whom a question names, how texts name people, what follow-ups ask, and what marks a profile."""

    triggers: tuple[str, ...] = tuple(SECOND_HOP)
    person: str = TEACHER
    names: NamePattern = field(default_factory=NamePattern)
    follow_up: str = FOLLOW_UP
    profile: tuple[str, ...] = tuple(PROFILE)


def split_names(x: Column, how: NamePattern | None = None) -> Column:
    """The names of a list: by default two to four CJK letters, or a capitalised word."""
    return entities.split_names(text(x), how or NamePattern())


def teacher_names(questions: DataFrame, candidates: DataFrame, postings: DataFrame | None = None, hop: HopProfile | None = None) -> DataFrame:
    """(qid, q, names): people of questions (qid, q) and of their first candidates (qid, ord from 1, idx, text), in order.

    postings: the entity index of the chunks, or of any table that holds the candidates'; without it, it is made of them.
    """
    hop = hop or HopProfile()
    first = candidates.where(F.col("ord") <= CANDIDATES).select("qid", "ord", "idx", text("text").alias("text"))
    postings = entities.entity_postings(first.select("idx", "text").distinct(), hop.names) if postings is None else postings
    courses = questions.select("qid", F.posexplode(course_titles(F.col("q"))).alias("nth", "course"))
    taught = entities.names_after(first.join(courses, "qid"), postings, ["qid", "ord", "nth"])
    taught = taught.groupBy("qid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "nth", "names"))), lambda x: x["names"])).alias("taught"))
    rows = questions.select("qid", "q").join(taught, "qid", "left")
    own = F.regexp_extract_all("q", F.lit(hop.person), F.lit(1))
    return rows.select("qid", "q", F.slice(F.array_distinct(F.concat(own, F.coalesce("taught", F.array().cast("array<string>")))), 1, NAMES).alias("names"))


def follow_ups(named: DataFrame, hop: HopProfile | None = None) -> DataFrame:
    """(qid, q, nth, name, followup) of questions that a second hop is taken for."""
    hop = hop or HopProfile()
    rows = named.where(contains_any(F.col("q"), hop.triggers)).select("qid", "q", F.posexplode("names").alias("nth", "name"))
    return rows.withColumn("followup", F.concat_ws(" ", "name", F.lit(hop.follow_up)))


def hop_scores(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """(qid, nth, idx, score) of ranked rows (qid, nth, idx, rank from 1): shares fall with the rank and add up."""
    share = lambda df, s: df.select("qid", "nth", "idx", (F.lit(s) / F.col("rank")).alias("share"))
    return share(dense, DENSE_SHARE).unionByName(share(sparse, BM25_SHARE)).groupBy("qid", "nth", "idx").agg(F.sum("share").alias("score"))


def hop_candidates(scored: DataFrame, hop: HopProfile | None = None) -> DataFrame:
    """scored (qid, nth, name, idx, score, boost, title, url, text) where the name is in the candidate, with final scores."""
    hay = haystack("title", "url", "text")
    profile = F.when(contains_any(hay, (hop or HopProfile()).profile), PROFILE_FOUND).otherwise(0.0)
    return scored.where(F.contains(hay, F.lower("name"))).withColumn("score", F.col("score") + F.col("boost") + FOUND + profile)


def adjusted(candidates: DataFrame) -> DataFrame:
    """candidates (q, names, score, title, url, text): for questions on a course, up if it or its teacher is in, else down."""
    hay = haystack("title", "url", "text")
    courses = course_titles(F.col("q"))
    course = F.exists(courses, lambda c: F.contains(hay, F.lower(c)))
    teacher = F.exists(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.contains(hay, F.lower(n)))
    delta = F.when(F.size(courses) == 0, 0.0).when(course, COURSE_HIT).when(teacher, TEACHER_HIT).otherwise(NO_HIT)
    return candidates.withColumn("score", F.col("score") + delta)
