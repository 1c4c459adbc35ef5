"""Declared schemas of all tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENTS = (
    "id STRING, title STRING, filename STRING, source_path STRING, source_type STRING, source_url STRING, "
    "source_format STRING, encoding STRING, page_count INT, doc_type STRING, content_domain STRING, chip_family STRING, "
    "version STRING, language STRING, is_entrypoint BOOLEAN, retrieval_priority INT, chunk_count INT, created_at TIMESTAMP"
)
CHUNKS = (
    "id STRING, document_id STRING, document_title STRING, chunk_index INT, block_id STRING, content STRING, block_type STRING, "
    "symbol_name STRING, doc_type STRING, content_domain STRING, chip_family STRING, version STRING, language STRING, "
    "is_entrypoint BOOLEAN, retrieval_priority INT, section_path ARRAY<STRING>, page_number INT, page_label STRING, "
    "line_start INT, line_end INT, paragraph_start INT, paragraph_end INT, source_uri STRING, location_label STRING, "
    "context_before STRING, context_after STRING, parent_block_id STRING, order_on_page INT, page_region STRING, "
    "role_confidence DOUBLE, extraction_confidence DOUBLE, table_parse_confidence STRING"
)
VECTORS = (
    "chunk_id STRING, document_id STRING, chunk_index INT, collection_id STRING, provider STRING, model STRING, dimension INT, "
    "chunk_hash STRING, embedding_text_hash STRING, chunk_schema_version STRING, parser_version STRING, chunker_version STRING, "
    "created_at TIMESTAMP, is_active BOOLEAN, `values` ARRAY<DOUBLE>"
)
TURNS = "session_id STRING, turn INT, role STRING, content STRING, created_at TIMESTAMP"
BLOCKS = (
    "document_id STRING, seq INT, text STRING, role STRING, section_path ARRAY<STRING>, symbol_name STRING, page_number INT, "
    "page_label STRING, line_start INT, line_end INT, paragraph_start INT, paragraph_end INT, source_uri STRING, location_label STRING"
)
PDF_PAGES = "document_id STRING, page_number INT, lines ARRAY<STRING>"
#: Versions written into vector records.
VERSIONS = {"chunk_schema_version": "v2", "parser_version": "document-ir-v1", "chunker_version": "chunk-strategy-v1"}


def names(ddl: str) -> list[str]:
    """Column names of a declared schema, without a session."""
    return [part.split()[0].strip("`") for part in ddl.split(", ")]


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The declared columns in order; absent ones are null of their type."""
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(ddl).fields])
