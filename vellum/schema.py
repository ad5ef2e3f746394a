"""Schemas of stored tables, and the checks on what goes into them."""

from __future__ import annotations

from pyspark.sql import DataFrame

DOCUMENTS = (
    "id string, filename string, status string, version int, chunk_count int, error string, created_at timestamp, updated_at timestamp, is_deleted boolean, original_name string, "
    "source_hash string, parser_version string, clean_rules_version string, chunker_version string, embedding_model string, content_status string"
)
CHUNKS = (
    "id string, document_id string, chunk_index int, document_version int, content string, embedding array<float>, department string, secret_level int, source_file string, "
    "create_time timestamp, updated_at timestamp, start_offset int, end_offset int, title string, is_deprecated boolean, page int, raw_table string, table_complex boolean, content_hash string, table_id string, image_path string"
)
BLOCK = "struct<pos:int,kind:string,text:string,page:int,raw_table:string,table_complex:boolean,meta:map<string,string>>"
PARSED = f"struct<ok:boolean,parser:string,pages:int,warnings:array<string>,attempts:array<struct<parser:string,error:string>>,blocks:array<{BLOCK}>>"

BLOCK_KINDS = ("paragraph", "heading", "table", "code")
ATOMIC_KINDS = ("table", "code")
STATUSES = ("pending", "processing", "completed", "failed", "deleted")
CONTENT_STATUSES = ("active", "stale", "deprecated")
STORES = ("real", "stress")


def checked_store(kb: str) -> str:
    """The name of a store; there is no default, and an unknown one is an error."""
    if kb not in STORES:
        raise ValueError(f"unknown store {kb!r}; known: {', '.join(STORES)}")
    return kb


def shape(df: DataFrame) -> list[tuple[str, str]]:
    return sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
