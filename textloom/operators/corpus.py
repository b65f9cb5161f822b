"""The corpus: incremental merge, cleaning into documents and chunks, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.columns import first_full, safe_int, strip, text
from textloom.operators.chunk import chunk_text, window_chunks
from textloom.schemas import CHUNK, DOCUMENT, RAW_CHUNK, RAW_DOCUMENT, names
from textloom.staging import stage

#: Bits of monotonically_increasing_id() that hold a row's place in its partition.
PLACES = 33


def column_or(df: DataFrame, name: str, kind: str = "string", default=None) -> Column:
    """df's column, or a default where df has none. A null in the column stays null."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(default).cast(kind)


def known_urls(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The distinct URLs that the corpus has, of any kind; no nulls or empty ones."""
    found = documents.select(F.col("url")).union(documents.select(column_or(documents, "canonical_url"))).union(chunks.select("url"))
    return found.where(text("url") != "").distinct()


def unseen(new: DataFrame, known: DataFrame, order: str = "line") -> DataFrame:
    """Rows of new with content whose URL isn't known; of a repeated URL, the first by `order`."""
    full = new.where(text("content") != "").join(known.select("url").distinct(), "url", "left_anti")
    first = Window.partitionBy("url").orderBy(order)
    return full.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def numbered(df: DataFrame, order: list[str], name: str, after: int | Column = 0, ranged: bool = False) -> DataFrame:
    """df with running numbers from after + 1 in the global order of the columns, which should be unique.

    Rows are sorted into range partitions, staged with their place, and numbered by partition offsets: no single task sees all
    rows, and they move once. ranged: df lies in range partitions by the first columns of the order already.
    """
    ranges = df if ranged else df.repartitionByRange(*order)
    # an increasing id is a partition's number and, in its lower bits, the row's place there
    staged = stage(ranges.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    placed = staged.withColumns({"_part": F.shiftright("_at", PLACES), "_n": F.col("_at").bitwiseAND(F.lit((1 << PLACES) - 1)) + 1})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    out = placed.join(F.broadcast(offsets), "_part")
    return out.withColumn(name, (F.col("_offset") + F.col("_n") + F.lit(after)).cast("bigint")).drop("_at", "_part", "_n", "_offset")


def largest_id(df: DataFrame, name: str) -> int:
    return df.agg(F.max(safe_int(name))).first()[0] or 0


def document_records(new: DataFrame, run_id: int, fetched_at: str) -> DataFrame:
    """Crawled items with an id as stored documents. Defaults stand for missing columns only, nulls stay."""
    own = lambda name, kind="string", default=None: column_or(new, name, kind, default)
    values = {
        "id": F.col("id").cast("bigint"),
        "run_id": F.lit(run_id).cast("bigint"),
        "url": F.col("url"),
        "canonical_url": F.coalesce(first_full(own("canonical_url")), F.col("url")),
        "title": own("title", default=""),
        "host": T.url_host("url"),
        "content_type": own("content_type", default="text/html"),
        "status_code": own("status_code", "int", 200),
        "fetched_at": F.lit(fetched_at),
        "valid_from": T.date_prefix(F.lit(fetched_at)),
        "validity_note": own("validity_note", default="merged_from_new_raw"),
        "sha256": T.content_sha256("content"),
        "depth": own("depth", "int", 0),
        "text_chars": F.length(text("content")).cast("bigint"),
    }
    return new.select(*(values.get(c, own(c)).alias(c) for c in names(RAW_DOCUMENT)))


def records(fresh: DataFrame, run_id: int, fetched_at: str, size: int = 900, overlap: int = 120) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of crawled items with an id."""
    added = fresh.select("id", "url", column_or(fresh, "title", default="").alias("title"), F.posexplode(window_chunks("content", size, overlap)).alias("i", "text"))
    more = added.select(F.col("id").alias("document_id"), F.concat_ws("-", "id", "i").alias("chunk_id"), F.col("i").cast("int").alias("chunk_index"), "url", "title", "text")
    return document_records(fresh, run_id, fetched_at), more.select(*names(RAW_CHUNK))


def merge(documents: DataFrame, chunks: DataFrame, new: DataFrame, fetched_at: str, size: int = 900, overlap: int = 120) -> tuple[DataFrame, DataFrame]:
    """Old documents and chunks with the unseen items of new (url, content, line and more) added: ids go on from the
    largest, in the order of lines."""
    fresh = unseen(new, known_urls(documents, chunks))
    after = max(largest_id(documents, "id"), largest_id(chunks, "document_id"))
    run_id = largest_id(documents, "run_id") + 1
    fresh = stage(numbered(fresh, ["line"], "id", after), "fresh")
    more_documents, more_chunks = records(fresh, run_id, fetched_at, size, overlap)
    return documents.unionByName(more_documents, allowMissingColumns=True), chunks.unionByName(more_chunks, allowMissingColumns=True)


def preprocess(documents: DataFrame, chunks: DataFrame, texts: DataFrame | None = None, max_chars: int = 900, overlap: int = 120, site_lines: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Clean documents and chunks.

    A document's raw chunks are cleaned each; those left empty go, and with all of them the document. A document without raw
    chunks takes its text from texts (id, content, path), which is cleaned and packed. Orphan chunks go.
    """
    own = lambda name, kind="string": column_or(documents, name, kind)
    docs = documents.select(
        F.col("id").cast("bigint").alias("id"),
        T.named(own("url"), own("canonical_url")).alias("url"),
        text(own("title")).alias("title"),
        own("category").alias("category"),
        own("language").alias("language"),
        first_full(own("text_path"), own("raw_path"), own("source_path")).alias("source_path"),
        own("content_type").alias("content_type"),
        own("text_chars", "bigint").alias("_chars"),
    )
    raw = chunks.where("document_id is not null").select(F.col("document_id").cast("bigint").alias("id"), text(column_or(chunks, "chunk_id")).alias("chunk_id"), F.coalesce(column_or(chunks, "chunk_index", "int"), F.lit(0)).alias("chunk_index"), T.clean_text("text", site_lines).alias("body"))
    raw = stage(raw, "raw-chunks")
    chunked = docs.join(raw, "id").where("body <> ''").withColumn("raw", F.coalesce("_chars", F.lit(0).cast("bigint")))
    chunked = chunked.withColumn("chunk_id", T.named("chunk_id", F.concat_ws("-", "id", "chunk_index")))
    rows = chunked.withColumn("whole", F.lit(None).cast("bigint"))  # the length of a text that was cleaned as a whole
    if texts is not None:
        whole = docs.join(raw.select("id").distinct(), "id", "left_anti").join(texts.where(text("content") != ""), "id")
        # an empty text has no chunks; to filter it here would clean every text twice, as filters move to the scan
        whole = whole.withColumn("cleaned", T.clean_text("content", site_lines))
        whole = whole.withColumns({"source_path": F.coalesce("path", "source_path"), "raw": F.coalesce(F.nullif("_chars", F.lit(0)), F.length("content")), "whole": F.length("cleaned").cast("bigint")})
        # an outer one, as a plain one is guarded by a filter that cleans and packs every text twice more
        pieces = whole.select("*", F.posexplode_outer(chunk_text("cleaned", max_chars, overlap)).alias("chunk_index", "piece")).where("chunk_index is not null")
        pieces = pieces.withColumns({"body": strip("piece"), "chunk_id": F.concat_ws("-", "id", "chunk_index")})
        rows = rows.unionByName(pieces.select(*rows.columns))
    rows = stage(rows, "clean-chunks")
    facts = ["id", "url", "title", "category", "language", "source_path", "content_type", "raw"]
    clean = F.coalesce(F.max("whole"), F.sum(F.length("body")))
    counted = rows.groupBy(*facts).agg(F.count("*").cast("int").alias("num_chunks"), clean.alias("clean"))
    out = counted.select(*(F.col({"text_chars_raw": "raw", "text_chars_clean": "clean"}.get(c, c)).alias(c) for c in names(DOCUMENT)))
    cleaned = rows.withColumns({"document_id": F.col("id"), "text": T.chunk_header("title", "url", "body"), "char_count": F.length("body")})
    return out, cleaned.select(*names(CHUNK))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def count_mismatches(source: dict[str, DataFrame], built: dict[str, DataFrame]) -> DataFrame:
    """(name, source_n, built_n) of tables whose row counts differ."""
    a, b = row_counts(source).withColumnRenamed("n", "source_n"), row_counts(built).withColumnRenamed("n", "built_n")
    return a.join(b, "name").where("source_n <> built_n")


def verify(source: dict[str, DataFrame], built: dict[str, DataFrame]) -> None:
    """Raise ValueError naming every table whose row count isn't that of its source."""
    wrong = count_mismatches(source, built).orderBy("name").collect()  # a row for each table at most
    if wrong:
        raise ValueError("row counts differ: " + "; ".join(f"{r['name']}: {r['source_n']} and {r['built_n']}" for r in wrong))
