"""Shared helpers: table access and bounded batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.staging import shared_path, small_batches, stage

__all__ = ["shared_path", "small_batches", "stage", "table", "text_or_empty", "text_slices", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_slices(batches: Iterable[pa.RecordBatch], text_column: str, max_bytes: int = 4 << 20, max_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds at most max_bytes of text, or one row."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text_column))
        sizes = pa.compute.binary_length(texts).to_pylist()
        start = used = 0
        for i, n in enumerate(sizes):
            n = n or 0
            if i > start and (used + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, used = i, 0
            used += n
        if len(sizes) > start:
            yield batch.slice(start)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
