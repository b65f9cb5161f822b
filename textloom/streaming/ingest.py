"""Streaming ingestion of crawl items: the incremental merge as a stream. An extension: batch merging is the base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textloom.functions.columns import text
from textloom.schemas import CRAWL_ITEM


def read_crawl(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Crawl items from JSON files as they appear in a folder."""
    return spark.readStream.schema(CRAWL_ITEM).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def ingest(items: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append items with content whose URL the Parquet store doesn't have; of equal URLs in a batch one stays.

    A batch that is run again after a failure finds its own URLs in the store and adds nothing twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        from textloom.sources.readers import exists

        fresh = batch.where(text("content") != "").dropDuplicates(["url"])
        if exists(batch.sparkSession, store):
            fresh = fresh.join(batch.sparkSession.read.schema(CRAWL_ITEM).parquet(store).select("url"), "url", "left_anti")
        fresh.write.mode("append").parquet(store)

    return items.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
