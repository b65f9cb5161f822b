"""Writers: JSON lines, statistics, tables, swaps in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.columns import safe_int
from textloom.functions.text import file_name

# The tables of a knowledge base, in the order they are built.
TABLES = [
    "crawl_runs", "documents", "chunks", "entities", "facts", "events", "leadership_roles", "program_sources",
    "program_requirements", "facilities", "staff_members", "faculty_members", "courses", "contacts", "openinfo_documents",
    "clinic_services", "dining_venues", "dorm_buildings", "transport_routes", "administrative_units",
]


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, in UTF-8, nulls written out."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def swap_jsonl(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Replace folders that the tables may themselves be read from, all or none.

    Each table is written beside its place; a marker then says that all of them are whole, and they are moved. What a failure
    left is undone before the marker is there, and completed after.
    """
    paths = list(tables)
    finish_swap(spark, paths)
    for path, df in tables.items():
        write_jsonl(df, path + ".new", "overwrite")
    fs, at = _files(spark, paths[0])
    fs.create(at(paths[0] + ".swap")).close()
    finish_swap(spark, paths)


def finish_swap(spark: SparkSession, paths: list[str]) -> None:
    """Complete or undo a swap of these folders that was cut off."""
    fs, at = _files(spark, paths[0])
    marked = fs.exists(at(paths[0] + ".swap"))
    for path in paths:
        if fs.exists(at(path + ".new")):
            if marked:
                fs.delete(at(path), True)
                fs.rename(at(path + ".new"), at(path))
            else:
                fs.delete(at(path + ".new"), True)
    fs.delete(at(paths[0] + ".swap"), False)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and its paths."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_stats(documents: DataFrame, chunks: DataFrame, path: str, **settings) -> None:
    """A row with the numbers of documents and chunks and the settings of a build."""
    row = documents.agg(F.count("*").alias("documents")).join(chunks.agg(F.count("*").alias("chunks")), F.lit(True))
    write_jsonl(row.select("*", *(F.lit(v).alias(k) for k, v in settings.items())).coalesce(1), path, "overwrite")


def fitted(rows: DataFrame, target: DataFrame) -> DataFrame:
    """rows with the target's columns and types: missing ones null, others dropped."""
    return rows.select(*((F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in target.schema))


def rebuild(spark: SparkSession, tables: dict[str, DataFrame], templates: dict[str, DataFrame], database: str) -> dict[str, int]:
    """Build a fresh database: each template's table, in order, with fitted rows. Returns the largest id of each, which new
    rows go on from."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    last = {}
    for name in [*(t for t in TABLES if t in templates), *sorted(set(templates) - set(TABLES))]:
        rows = fitted(tables[name], templates[name]) if name in tables else templates[name].limit(0)
        rows.write.mode("overwrite").saveAsTable(f"`{database}`.`{name}`")
        if "id" in rows.columns:
            last[name] = spark.table(f"`{database}`.`{name}`").agg(F.max(safe_int("id"))).first()[0] or 0
    return last


def write_index(embeddings: DataFrame, meta: DataFrame, path: str) -> None:
    """Vectors and the meta columns of an index, both keyed by idx."""
    embeddings.select("idx", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(f"{path}/vectors")
    meta.select("idx", "chunk_id", "title", "url", "category", "text").write.mode("overwrite").parquet(f"{path}/meta")


def export_tables(spark: SparkSession, database: str, path: str, source: str | None = None) -> None:
    """JSON lines of every table; those of a source folder are taken as they are."""
    from textloom.sources.readers import catalogue, exists

    for name in catalogue(spark, database):
        if source and exists(spark, f"{source}/{name}.jsonl"):
            spark.read.text(f"{source}/{name}.jsonl").write.mode("overwrite").text(f"{path}/{name}.jsonl")
        else:
            df = spark.table(f"`{database}`.`{name}`")
            write_jsonl(df.orderBy("id") if "id" in df.columns else df, f"{path}/{name}.jsonl", "overwrite")


def unwritten(documents: DataFrame, done: DataFrame, key: str = "text_path") -> DataFrame:
    """Documents whose text isn't materialised yet."""
    return documents.where(F.col(key).isNotNull()).join(done.select(key).distinct(), key, "left_anti")


def pdf_targets(items: DataFrame) -> DataFrame:
    """(file_url, file_name) of the PDFs that crawl items name; of equal names the last URL stands."""
    urls = items.select(F.explode("file_urls").alias("file_url")).distinct()
    return urls.withColumn("file_name", file_name("file_url")).groupBy("file_name").agg(F.max("file_url").alias("file_url"))


def append_checkpoint(df: DataFrame, path: str) -> None:
    """Add finished rows to a CSV folder, so that a run can go on where it stopped."""
    df.write.mode("append").option("header", "true").csv(path)
