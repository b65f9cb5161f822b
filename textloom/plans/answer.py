"""Answers and batch evaluation."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.columns import text
from textloom.operators.context import NO_QUESTION, NO_SOURCES, Renderer, build_prompts, generate, source_list
from textloom.operators.corpus import numbered
from textloom.plans.search import Retriever
from textloom.schemas import EVALUATION, names
from textloom.sources.sinks import _files
from textloom.staging import shared_path, stage

#: What a model is told where the caller brings no wording of its own.
INSTRUCTION = "Use nothing but the numbered sources below. Name the numbers you rely on. If the sources do not settle the question, say what is missing. Write in the language of the question."


def render_plain(question: Column, context: Column, instruction: str = INSTRUCTION) -> Column:
    """A prompt as plain text; models with a chat template bring their own renderer."""
    return F.concat(F.lit(instruction + "\n\n"), context, F.lit("\n\n"), question)


def checked_model_name(name: str) -> str:
    """A model's name or folder; placeholders, empty names and missing folders raise."""
    if not name:
        raise ValueError("a model name must not be empty")
    if "/path/to/your" in name:
        raise ValueError("the model name is still a placeholder")
    if name.startswith("/") and not os.path.exists(name):
        raise FileNotFoundError(f"there is no model folder {name}")
    return name


@dataclass
class Answerer:
    """Retrieval, prompt and an injected model."""

    retriever: Retriever
    model: Callable[[list[str]], list[str]]
    top_k: int = 5
    render: Renderer = render_plain

    def answer(self, questions: DataFrame, hybrid: bool | None = None) -> tuple[DataFrame, DataFrame]:
        """(answers, contexts) for questions (qid, q): one row (qid, question, answer) each, and the sources with ranks."""
        contexts = stage(self.retriever.search(questions, self.top_k, hybrid), "contexts")
        asked = questions.select(F.col("qid").cast("bigint").alias("qid"), F.col("q").alias("question"))
        listed = asked.join(contexts.select("qid", "rank", "text"), "qid", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
        return generate(build_prompts(listed, self.render), self.model).select("qid", "question", "answer"), contexts

    def ask(self, spark, question: str, hybrid: bool = True) -> tuple[str, str]:
        """(answer, source list) of one question, as a user interface shows them."""
        question = (question or "").strip()
        if not question:
            return NO_QUESTION, NO_SOURCES
        answers, contexts = self.answer(spark.createDataFrame([(0, question)], "qid long, q string"), hybrid)
        listing = source_list(contexts).first()
        return answers.first()["answer"], listing["listing"] if listing else NO_SOURCES


ANSWERED = "qid BIGINT, asked STRING, answer STRING, titles STRING, latency DOUBLE"


def answered(answerer: Answerer, asked: DataFrame, config: str, hybrid: bool, checkpoint: str, batch: int = 1000) -> DataFrame:
    """(qid, answer, titles, latency) for questions (qid, q), each asked once over all runs with the same checkpoint folder.

    Questions go to the model in batches by qid. A batch's rows are written under a hidden name and moved into the
    configuration's folder when they are whole, so a run that was stopped leaves whole batches only, and the next one asks what
    no batch has: an answer belongs to its configuration, its qid and the text of its question. Latencies are of a batch, divided
    by its questions. qid is distinct and not null; one run at a time writes a configuration.
    """
    spark = asked.sparkSession
    place = f"{checkpoint.rstrip('/')}/config={quote(config, safe='')}"
    fs, at = _files(spark, place)
    fs.mkdirs(at(place))
    digest = F.sha2(text("q"), 256).alias("asked")
    keyed = asked.select(F.col("qid").cast("bigint").alias("qid"), "q", digest)
    parts = lambda: spark.read.schema(ANSWERED).parquet(place).select(*names(ANSWERED))
    left = numbered(keyed.join(parts().select("qid", "asked"), ["qid", "asked"], "left_anti"), ["qid"], "n", -1)
    left = stage(left, "unanswered")
    for i in range(-(-left.count() // batch)):
        part = left.where(F.floor(F.col("n") / batch) == i).drop("n")
        n, began = part.count(), time.time()
        answers, contexts = answerer.answer(part.select("qid", "q"), hybrid)
        rows = stage(part.join(answers.select("qid", "answer"), "qid", "left").join(source_titles(contexts), "qid", "left"), "answers")
        rows = rows.withColumn("latency", F.lit(round((time.time() - began) / n, 2)))
        name = uuid.uuid4().hex
        rows.select(*names(ANSWERED)).write.parquet(f"{place}/.{name}")
        if not fs.rename(at(f"{place}/.{name}"), at(f"{place}/part={name}")):
            raise RuntimeError(f"a batch could not be moved into {place}")
    return keyed.drop("q").join(parts(), ["qid", "asked"]).drop("asked")


def evaluate(answerer: Answerer, items: DataFrame, checkpoint: str | None = None, batch: int = 1000) -> DataFrame:
    """The evaluation's table for test items (qid, query, gt_answer, type): both modes side by side, correctness left open.
    With a checkpoint folder a run goes on where another one stopped."""
    out = items.select("qid", "query", F.coalesce("gt_answer", F.lit("")).alias("gt_answer"), F.coalesce("type", F.lit("")).alias("type"))
    folder = checkpoint or shared_path(items.sparkSession, "answers")
    for name, hybrid in (("dense", False), ("hybrid", True)):
        rows = answered(answerer, items.select("qid", F.col("query").alias("q")), name, hybrid, folder, batch)
        own = {"answer": f"sys_resp_{name}", "titles": f"sources_{name}", "latency": f"latency_{name}_s"}
        out = out.join(rows.withColumnsRenamed(own), "qid", "left").withColumn(f"is_correct_{name}", F.lit(""))
    return out.orderBy("qid").select(*EVALUATION)


def compare(answerer: Answerer, items: DataFrame, configs: dict[str, bool], checkpoint: str | None = None, batch: int = 1000) -> DataFrame:
    """(query, gt_answer, type, resp_<name>, lat_<name>...) for each configuration, hybrid or not. With a checkpoint folder a
    run goes on where another one stopped."""
    out = items.select("qid", "query", F.coalesce("gt_answer", F.lit("")).alias("gt_answer"), F.coalesce("type", F.lit("")).alias("type"))
    folder = checkpoint or shared_path(items.sparkSession, "answers")
    for name, hybrid in configs.items():
        rows = answered(answerer, items.select("qid", F.col("query").alias("q")), name, hybrid, folder, batch)
        out = out.join(rows.drop("titles").withColumnsRenamed({"answer": f"resp_{name}", "latency": f"lat_{name}"}), "qid", "left")
    return out.orderBy("qid").drop("qid")


def accuracy(judged: DataFrame, by: list[str], types: list[str] | None = None) -> DataFrame:
    """Correct and all judged rows (correct 0 or 1) by columns; with types, correct ones pivoted by type."""
    if types is None:
        return judged.groupBy(*by).agg(F.sum("correct").alias("correct"), F.count("correct").alias("total"), F.round(F.avg("correct"), 6).alias("accuracy"))
    return judged.groupBy(*by).pivot("type", types).agg(F.sum("correct"))


def source_titles(contexts: DataFrame) -> DataFrame:
    """(qid, titles) of contexts (qid, rank, title): the titles of a question's sources by rank, in one text."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "title")))
    return contexts.groupBy("qid").agg(F.array_join(F.transform(listed, lambda x: x["title"]), " | ").alias("titles"))


def to_csv_with_mark(df: DataFrame, path: str, files: int | None = None) -> None:
    """A folder of CSV files that each begin with a byte order mark and the header; `files` of them if asked for."""
    marked = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    (marked if files is None else marked.coalesce(files)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
