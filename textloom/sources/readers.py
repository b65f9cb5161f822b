"""Readers: JSON lines, tables, files, the catalogue."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions.columns import first_full, text
from textloom.functions.text import collapse_whitespace, html_text, slashes
from textloom.operators.corpus import numbered
from textloom.schemas import RAW_DOCUMENT, TEST_ITEM, names

# Suffixes of files that hold HTML.
TEXT_SUFFIXES = [".htm", ".html", ".asp", ".php", ".jsp", ".psp"]


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of several places that is there."""
    return next((p for p in paths if exists(spark, p)), None)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, malformed ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_ordered(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """read_jsonl with line, which grows with a row's place: files by name, their splits by offset, rows by place. With a
    limit, the first `limit` rows.

    Spark takes splits in the order of their sizes, so a row's number alone says nothing of files' order.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    rows = read_jsonl(spark, path, schema).withColumn("line", place)
    return rows if limit is None else rows.orderBy("line").limit(limit)


def optional_jsonl(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """read_jsonl, or no rows where there is no file."""
    if path is None or not exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_jsonl(spark, path, schema)


def visited_urls(spark: SparkSession, path: str) -> DataFrame:
    """The URLs of an earlier crawl."""
    return optional_jsonl(spark, path, "url STRING").where("url is not null").distinct()


def test_items(spark: SparkSession, path: str) -> DataFrame:
    """Test items with their number from 0 in the order of lines."""
    return numbered(read_jsonl_ordered(spark, path, TEST_ITEM), ["line"], "qid", -1).drop("line")


def stored_documents(spark: SparkSession, table: str) -> DataFrame:
    """The 21 columns of stored documents from a catalogue table, by id."""
    return spark.table(table).select(*names(RAW_DOCUMENT)).orderBy("id")


def jdbc_table(spark: SparkSession, url: str, table: str, driver: str | None = None) -> DataFrame:
    """A table of a database whose JDBC driver the cluster has."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    return (reader.option("driver", driver) if driver else reader).load()


def catalogue(spark: SparkSession, database: str, without: tuple[str, ...] = ("sqlite_", "chunks_fts")) -> list[str]:
    """The tables of a database, by name, without those that begin with a given string."""
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary and not t.name.startswith(without))


@F.pandas_udf(StringType())
def decoded(xs: pd.Series) -> pd.Series:
    """UTF-8 as text; bytes that are none go."""
    return xs.map(lambda b: b.decode("utf-8", "ignore"), na_action="ignore")


def text_by_suffix(path: Column, content: Column, pdf: Callable[[Column], Column] | None = None, parser: bool = False) -> Column:
    """The text of a file by its suffix: HTML extracted, PDF by an injected function (empty without one), others as they
    are."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    body = decoded(content)
    out = F.when(suffix.isin(TEXT_SUFFIXES), html_text(body, parser))
    out = out.when(suffix == ".pdf", collapse_whitespace(pdf(content)) if pdf else F.lit(""))
    return out.otherwise(body)


def document_texts(spark: SparkSession, documents: DataFrame, base: str, pdf: Callable[[Column], Column] | None = None, parser: bool = False) -> DataFrame:
    """(id, content, path): each document's text from its text file, or else its raw file, below base.

    Files are joined by relative path; documents with neither have no row.
    """
    root = base.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # what follows the base in a file's full name
    tail = F.regexp_replace(F.col("path"), "^.*?" + _quoted(root.split("://", 1)[-1].rstrip("/")) + "/", "")
    files = found.select(tail.alias("rel"), "content")
    wanted = documents.select("id", F.explode(F.filter(F.array(F.struct(F.lit(0).alias("nth"), slashes(first_full("text_path")).alias("rel")), F.struct(F.lit(1).alias("nth"), slashes(first_full("raw_path")).alias("rel"))), lambda x: x["rel"].isNotNull())).alias("x")).select("id", "x.nth", "x.rel")
    hit = wanted.join(files.select("rel"), "rel").groupBy("id").agg(F.min(F.struct("nth", "rel")).alias("x")).select("id", "x.nth", "x.rel")
    rows = hit.join(files, "rel")
    body = F.when(F.col("nth") == 0, decoded("content")).otherwise(text_by_suffix(F.col("rel"), F.col("content"), pdf, parser))
    return rows.select("id", text(body).alias("content"), F.col("rel").alias("path"))


def _quoted(path: str) -> str:
    """A literal for a Java pattern."""
    return "\\Q" + path.replace("\\E", "") + "\\E"
