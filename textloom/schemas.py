"""Schemas of the stored entities, as DDL."""

CRAWL_ITEM = "url STRING, title STRING, content STRING, file_urls ARRAY<STRING>"
RAW_DOCUMENT = (
    "id BIGINT, run_id BIGINT, url STRING, canonical_url STRING, title STRING, host STRING, category STRING, language STRING, "
    "content_type STRING, status_code INT, fetched_at STRING, source_published_at STRING, valid_from STRING, valid_until STRING, "
    "validity_note STRING, raw_path STRING, text_path STRING, sha256 STRING, depth INT, parent_url STRING, text_chars BIGINT"
)
RAW_CHUNK = "document_id BIGINT, chunk_id STRING, chunk_index INT, url STRING, title STRING, text STRING"
DOCUMENT = (
    "id BIGINT, url STRING, title STRING, category STRING, language STRING, source_path STRING, content_type STRING, "
    "text_chars_raw BIGINT, text_chars_clean BIGINT, num_chunks INT"
)
CHUNK = (
    "chunk_id STRING, document_id BIGINT, chunk_index INT, title STRING, url STRING, category STRING, language STRING, "
    "text STRING, char_count INT, source_path STRING"
)
INDEX_META = "idx BIGINT, chunk_id STRING, title STRING, url STRING, category STRING, text STRING"
TEST_ITEM = "query STRING, gt_answer STRING, type STRING"
#: Columns of the batch evaluation's table, in order.
EVALUATION = [
    "query", "gt_answer", "sys_resp_dense", "sys_resp_hybrid", "is_correct_dense", "is_correct_hybrid",
    "type", "latency_dense_s", "latency_hybrid_s", "sources_dense", "sources_hybrid",
]


def names(ddl: str) -> list[str]:
    """The column names of a DDL string without nested fields."""
    return [part.split()[0] for part in ddl.split(", ")]
