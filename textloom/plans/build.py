"""Building a knowledge base: crawl items to merged, cleaned, chunked and verified tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from textloom.operators.corpus import merge, preprocess, verify
from textloom.schemas import CRAWL_ITEM, RAW_CHUNK, RAW_DOCUMENT
from textloom.sources.readers import document_texts, optional_jsonl, read_jsonl_ordered
from textloom.sources.sinks import finish_swap, swap_jsonl, write_jsonl, write_stats


@dataclass
class BuildConfig:
    input_dir: str
    output_dir: str
    max_chars: int = 900
    overlap_chars: int = 120

    def check(self) -> None:
        if self.input_dir.rstrip("/") == self.output_dir.rstrip("/"):
            raise ValueError("input and output folder must differ")


def merge_crawl(spark: SparkSession, folder: str, crawl: str, fetched_at: str) -> None:
    """Add a crawl's items to the documents and chunks of a folder, in place, both or neither."""
    finish_swap(spark, [f"{folder}/merged_documents.jsonl", f"{folder}/merged_chunks.jsonl"])
    documents = optional_jsonl(spark, f"{folder}/merged_documents.jsonl", RAW_DOCUMENT)
    chunks = optional_jsonl(spark, f"{folder}/merged_chunks.jsonl", RAW_CHUNK)
    documents, chunks = merge(documents, chunks, read_jsonl_ordered(spark, crawl, CRAWL_ITEM), fetched_at)
    swap_jsonl(spark, {f"{folder}/merged_documents.jsonl": documents, f"{folder}/merged_chunks.jsonl": chunks})


def build(spark: SparkSession, config: BuildConfig, with_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """Clean the merged tables of the input folder into the output folder, with statistics, and verify what was written."""
    config.check()
    documents = optional_jsonl(spark, f"{config.input_dir}/merged_documents.jsonl", RAW_DOCUMENT)
    chunks = optional_jsonl(spark, f"{config.input_dir}/merged_chunks.jsonl", RAW_CHUNK)
    texts = document_texts(spark, documents, config.input_dir) if with_files else None
    docs, parts = preprocess(documents, chunks, texts, config.max_chars, config.overlap_chars)
    out = config.output_dir
    for name, df in (("documents_cleaned", docs), ("chunks_cleaned", parts)):
        write_jsonl(df, f"{out}/{name}.jsonl", "overwrite")
    written = {n: spark.read.schema(df.schema).json(f"{out}/{n}.jsonl") for n, df in (("documents_cleaned", docs), ("chunks_cleaned", parts))}
    verify({"documents_cleaned": docs, "chunks_cleaned": parts}, written)
    write_stats(*written.values(), f"{out}/preprocess_stats.json", max_chars=config.max_chars, overlap_chars=config.overlap_chars, input_dir=config.input_dir, output_dir=out)
    return tuple(written.values())
