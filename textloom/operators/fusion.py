"""Fusing ranked lists, and ordered deduplication of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import canonical_url, signature
from textloom.staging import shared_path, stage

RRF_K, DENSE_WEIGHT, BM25_WEIGHT = 60, 1.0, 1.35
ITEM = "struct<ord:bigint,idx:bigint,url:string,sig:string>"


def rrf(lists: DataFrame, k: int = RRF_K, digits: int | None = None) -> DataFrame:
    """(qid, idx, score, first) of ranked rows (qid, list, weight, idx, rank from 1): the sum of weight / (k + rank).

    first is where an item is met first, by list and rank, which breaks ties.
    """
    total = F.sum(F.col("weight") / (k + F.col("rank")))
    return lists.groupBy("qid", "idx").agg((F.round(total, digits) if digits is not None else total).alias("score"), F.min(F.struct("list", "rank")).alias("first"))


def cut(fused: DataFrame, n: int, *ties: str | Column) -> DataFrame:
    """The n best rows of each query, with their rank from 1."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), *ties)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def greedy_dedup(items: Column) -> Column:
    """Of an ordered array of (ord, idx, url, sig), those that share neither URL nor signature with a kept one before. An
    item that goes takes neither key. An empty URL is no key."""
    strings = F.array().cast("array<string>")
    start = F.struct(F.array().cast(f"array<{ITEM}>").alias("kept"), strings.alias("urls"), strings.alias("sigs"))

    def step(acc: Column, x: Column) -> Column:
        seen = F.array_contains(acc["urls"], x["url"]) | F.array_contains(acc["sigs"], x["sig"])
        urls = F.when(x["url"] == "", acc["urls"]).otherwise(F.array_append(acc["urls"], x["url"]))
        return F.when(seen, acc).otherwise(F.struct(F.array_append(acc["kept"], x).alias("kept"), urls.alias("urls"), F.array_append(acc["sigs"], x["sig"]).alias("sigs")))

    return F.aggregate(items, start, step, lambda acc: acc["kept"])


def first_keys(keyed: DataFrame) -> DataFrame:
    """(qid, ord) of the rows of keyed (qid, ord, idx, url, sig) that the ordered fold keeps; it sees a query's list as a whole."""
    item = F.struct(F.col("ord").cast("bigint").alias("ord"), F.col("idx").cast("bigint").alias("idx"), "url", "sig").cast(ITEM)
    kept = keyed.select("qid", item.alias("x")).groupBy("qid").agg(greedy_dedup(F.array_sort(F.collect_list("x"))).alias("kept"))
    return kept.select("qid", F.explode("kept.ord").alias("ord"))


def dedup_candidates(candidates: DataFrame, canonical: bool = True) -> DataFrame:
    """Rows of candidates (qid, ord, idx, url, text, and more) that stay, by their order in each query.

    The fold sees a query's candidate list only, which recall has cut to a fixed depth.
    """
    url = canonical_url("url") if canonical else F.coalesce("url", F.lit(""))
    stay = first_keys(candidates.select("qid", "ord", "idx", url.alias("url"), signature("text").alias("sig")))
    return candidates.join(stay, ["qid", "ord"], "left_semi")


def dedup_long_lists(candidates: DataFrame, canonical: bool = True) -> DataFrame:
    """dedup_candidates for lists of any length: a query's candidates lie in many tasks.

    The kept rows are the first independent set by order, where rows that share a key exclude each other. Of equal pairs of keys
    the first row stands for all. In a round, a row is kept if none before it shares its URL or its signature, and what shares a
    key with a kept row goes. Rows that are kept are a part, by round, of one written table. A round's joins meet one row for
    each key, so a frequent key's rows can be split. Rounds are as many as the longest run of rows of which each waits for the
    one before: few for keys of ordinary texts, up to half the list in the worst case.

    Cases: `ord` is distinct within a query; null and empty URLs are no key; empty signatures are one, as in the fold.
    """
    spark = candidates.sparkSession
    url = canonical_url("url") if canonical else F.coalesce("url", F.lit(""))
    keyed = candidates.select("qid", F.col("ord").cast("bigint").alias("ord"), url.alias("url"), signature("text").alias("sig"))
    left = keyed.groupBy("qid", "url", "sig").agg(F.min("ord").alias("ord"))
    # a row without URL has one of its own, so that such rows meet nothing by URL and lie in all tasks
    left = stage(left.withColumn("url", F.when(F.col("url") == "", F.concat(F.lit("\0"), F.col("ord").cast("string"))).otherwise(F.col("url"))), "dedup-left")
    at, schema = shared_path(spark, "dedup-kept"), "qid bigint, ord bigint, round int"
    rounds = 0
    while not left.isEmpty():
        by_url = left.groupBy("qid", "url").agg(F.min("ord").alias("url_first"))
        by_sig = left.groupBy("qid", "sig").agg(F.min("ord").alias("sig_first"))
        first = (F.col("ord") == F.col("sig_first")) & (F.col("ord") == F.col("url_first"))
        met = stage(left.join(by_url, ["qid", "url"]).join(by_sig, ["qid", "sig"]).select("qid", "ord", "url", "sig", first.alias("kept")), "dedup-round")
        kept = met.where("kept")
        kept.select(F.col("qid").cast("bigint").alias("qid"), "ord").write.parquet(f"{at}/round={rounds}")
        rest = met.where("not kept").join(kept.select("qid", "url"), ["qid", "url"], "left_anti").join(kept.select("qid", "sig"), ["qid", "sig"], "left_anti")
        left = stage(rest.select("qid", "url", "sig", "ord"), "dedup-left", instead_of=left)
        rounds += 1
    if not rounds:
        return candidates.limit(0)
    return candidates.join(spark.read.schema(schema).parquet(at).select("qid", "ord"), ["qid", "ord"], "left_semi")
