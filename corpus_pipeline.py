"""A pipeline over `documents`: quality, near duplicates, secrets, packing. Part of the optional subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import near_copies, packing, quality, secret_scan
from textloom.llm.common import stage, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It is trained on the labelled documents that came in.

    Cases: rows with null or empty texts are scored like any other and may go; repeated rows all stay or all go; without labels
    all stay; all columns are kept as they are; an empty table gives no rows.
    """
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8), the document of the smallest doc_id.

    Cases: null and empty texts are copies of each other; of repeated rows one stays; different texts of one doc_id are judged
    apart; rows without doc_id stay and stand for no other; all columns are kept; an empty table gives no rows.
    """
    return near_copies.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark.

    Cases: null texts stay null; every row stays, repeated ones too; n_chars is counted again where a text changed; other
    columns are kept; an empty table gives no rows.
    """
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens.

    Cases: null and empty texts are one piece of one token; repeated rows and rows without doc_id are packed each; other
    columns are dropped, whatever their names; an empty table gives no rows.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", one_of_near_duplicates),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: SQL has neither the network, nor XXH64, nor the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, each one's result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"), instead_of=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
