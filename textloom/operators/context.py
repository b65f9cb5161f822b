"""Context windows, token budgets, prompts and source lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.columns import WS, strip, text
from textloom.functions.text import snippet

MAX_CONTEXT_CHARS, MAX_LEN, NEW_TOKENS, MARGIN, LEAST_PIECE = 3200, 12288, 512, 64, 32
NO_SOURCES, NO_QUESTION = "无可用来源。", "请输入问题。"

#: A token counter maps a column of texts to one of token counts, a cutter (texts, n) to the texts of their first n tokens, a
#: renderer (questions, contexts) to prompts; for instance by pandas UDFs.
Counter = Callable[[Column], Column]
Cutter = Callable[[Column, Column], Column]
Renderer = Callable[[Column, Column], Column]

#: The default tokens: each CJK letter, and other runs without white space.
TOKEN = rf"[一-鿿]|[^\s\x1c-\x1f\x85\p{{Z}}一-鿿]+"
#: How often a prompt that is still too long is cut by what it is over.
SHRINKS = 3


def neighbour_text(chunks: DataFrame, window: int = 1, max_chars: int = MAX_CONTEXT_CHARS) -> DataFrame:
    """chunks (doc_id, chunk_index, text) with context: the distinct texts of its neighbours within the window, in order."""
    near = Window.partitionBy("doc_id").orderBy("chunk_index").rangeBetween(-window, window)
    joined = F.array_join(F.array_distinct(F.transform(F.collect_list(F.struct("chunk_index", text("text").alias("t"))).over(near), lambda x: x["t"])), "\n\n")
    return chunks.withColumn("context", F.substring(F.coalesce(F.nullif(strip(joined), F.lit("")), text("text")), 1, max_chars))


def with_parent_window(candidates: DataFrame, chunks: DataFrame, window: int = 1, max_chars: int = MAX_CONTEXT_CHARS) -> DataFrame:
    """Few candidates (qid, idx, doc_id, chunk_index, text, and more) with their neighbours' texts from chunks, found by key:
    only the wanted neighbours are read from chunks. Candidates without a key keep their text."""
    wanted = candidates.where("doc_id is not null and chunk_index is not null").select("qid", "idx", "doc_id", F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index"))
    place = F.col("idx") if "idx" in chunks.columns else F.lit(0)
    found = wanted.join(chunks.select("doc_id", "chunk_index", F.struct(place.alias("i"), F.col("text").alias("t")).alias("_x")), ["doc_id", "chunk_index"])
    found = found.groupBy("qid", "idx", "chunk_index").agg(F.max("_x")["t"].alias("_t"))  # of chunks with one key, the last
    merged = found.groupBy("qid", "idx").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "_t"))), lambda x: x["_t"])), "\n\n").alias("_merged"))
    out = candidates.join(merged, ["qid", "idx"], "left")
    whole = F.nullif(strip(text("_merged")), F.lit(""))
    return out.withColumn("text", F.when(whole.isNull(), F.col("text")).otherwise(F.substring(whole, 1, max_chars))).drop("_merged")


def budgeted(pieces: DataFrame, budget: int | Column, least: int = LEAST_PIECE) -> DataFrame:
    """Pieces (qid, rank, tokens) with keep, the tokens that stay of each: whole ones while they fit, then a prefix of the
    first that doesn't if more than `least` tokens are left, then none (null)."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    order = Window.partitionBy("qid").orderBy("rank")
    used = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = pieces.withColumn("_used", used)
    rows = rows.withColumn("_over", (F.col("_used") > budget).cast("int")).withColumn("_nth", F.sum("_over").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    left = budget - (F.col("_used") - F.col("tokens"))
    keep = F.when(F.col("_nth") == 0, F.col("tokens")).when((F.col("_nth") == 1) & (F.col("_over") == 1) & (left > least), left)
    return rows.withColumn("keep", keep).drop("_used", "_over", "_nth")


def within_budget(pieces: DataFrame, budget: int | Column, least: int = LEAST_PIECE) -> DataFrame:
    """The pieces that stay, with what is kept of each."""
    return budgeted(pieces, budget, least).where("keep is not null")


def source_list(contexts: DataFrame, width: int = 300) -> DataFrame:
    """(qid, listing) of contexts (qid, rank, title, url, text): number, title, URL and snippet of each source."""
    entry = F.concat(F.col("rank").cast("string"), F.lit(". "), text("title"), F.lit("\n   URL: "), text("url"), F.lit("\n   摘要: "), snippet("text", width))
    return contexts.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))), lambda x: x["e"]), "\n").alias("listing"))


def numbered_piece(rank: Column | str, body: Column | str) -> Column:
    return F.concat(F.lit("[资料"), F.col(rank).cast("string") if isinstance(rank, str) else rank.cast("string"), F.lit("] "), text(body))


def tokens_in(x: Column) -> Column:
    """The default token counter."""
    return F.size(F.regexp_extract_all(text(x), F.lit(TOKEN), F.lit(0)))


def first_tokens(x: Column, n: Column) -> Column:
    """The default cutter: a text up to the end of its n-th token."""
    spaced = F.regexp_extract_all(text(x), F.lit(f"{WS}*+(?:{TOKEN})"), F.lit(0))
    return F.when(tokens_in(x) <= n, text(x)).otherwise(F.array_join(F.slice(spaced, 1, n), ""))


def build_prompts(contexts: DataFrame, render: Renderer, max_len: int = MAX_LEN, new_tokens: int = NEW_TOKENS, count: Counter = tokens_in, cut: Cutter = first_tokens) -> DataFrame:
    """(qid, question, prompt) of contexts (qid, question, rank, text); a null text is none.

    A prompt leaves room for the answer. It holds all of a question's contexts if they fit together, or else those that the
    budget takes by rank. Where tokens of the whole are more than those of the parts, the last part is cut by what the prompt
    is over, a few times, and goes if that isn't enough. A question that alone is too long raises.
    """
    room = max_len - new_tokens - MARGIN
    if room <= 0:
        raise ValueError(f"{max_len} tokens leave no room for {new_tokens} new ones")
    asked = contexts.select("qid", "question").distinct().withColumn("left", F.lit(room) - count(render(F.col("question"), F.lit(""))))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    pieces = contexts.where("text is not null").select("qid", "text", nth.alias("rank")).withColumn("piece", numbered_piece("rank", "text"))
    pieces = budgeted(pieces.withColumn("tokens", count(F.col("piece"))).join(asked.select("qid", "left"), "qid"), F.col("left"))
    pieces = pieces.withColumn("part", F.when(F.col("keep") == F.col("tokens"), F.col("piece")).when(F.col("keep").isNotNull(), cut(F.col("piece"), F.col("keep").cast("int"))))
    lists = pieces.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "piece", "part"))).alias("x"))  # a question has few
    empty = F.array().cast("array<string>")
    rows = asked.join(lists, "qid", "left").withColumns({"all": F.coalesce(F.col("x.piece"), empty), "parts": F.filter(F.coalesce(F.col("x.part"), empty), lambda y: y.isNotNull())})
    prompt = lambda parts: render(F.col("question"), F.array_join(parts, "\n\n"))
    rows = rows.withColumn("parts", F.when(count(prompt(F.col("all"))) <= room, F.col("all")).otherwise(F.col("parts")))

    def shrunk(df: DataFrame, last: bool) -> DataFrame:
        df = df.withColumn("_end", F.coalesce(F.try_element_at("parts", F.lit(-1)), F.lit("")))
        keep = count(F.col("_end")) - (count(prompt(F.col("parts"))) - room)
        df = df.withColumn("_keep", F.when(F.size("parts") > 0, keep).otherwise(0))
        before = F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0)))
        over = (F.size("parts") > 0) & (F.col("_keep") < count(F.col("_end")))
        less = before if last else F.when(F.col("_keep") > 0, F.concat(before, F.array(cut(F.col("_end"), F.col("_keep").cast("int"))))).otherwise(before)
        return df.withColumn("parts", F.when(over, less).otherwise(F.col("parts"))).drop("_end", "_keep")

    rows = reduce(lambda df, i: shrunk(df, i == SHRINKS), range(SHRINKS + 1), rows)
    alone = F.raise_error(F.lit("the question alone is longer than the prompt may be")).cast("string")
    return rows.select("qid", "question", F.when(F.col("left") < 0, alone).otherwise(prompt(F.col("parts"))).alias("prompt"))


def generate(prompts: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """prompts (qid, prompt, and more) with answer, by an injected model that takes batches of prompts."""
    from textloom.functions.text import after_thinking

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            yield pd.Series(model(xs.tolist()), dtype=object)

    return prompts.withColumn("answer", after_thinking(run("prompt")))
