"""Explicit schemas of the stored tables, as DDL."""

from typing import NamedTuple

ASSET = "asset_id:STRING,doc_id:STRING,page_no:INT,object_type:STRING,asset_path:STRING,bbox:ARRAY<ARRAY<DOUBLE>>,text:STRING,confidence:DOUBLE,metadata:STRING"
CHUNK = (
    "schema_version STRING, type STRING, chunk_id STRING, doc_id STRING, title STRING, source_title STRING, source_filename STRING, source_type STRING, source_path STRING, "
    "chunk_index INT, page_start INT, page_end INT, pages ARRAY<INT>, chunk_type STRING, topic STRING, token_estimate INT, char_count INT, citation_anchor STRING, text STRING, "
    f"assets ARRAY<STRUCT<{ASSET}>>, ocr_confidence_min DOUBLE, ocr_confidence_avg DOUBLE, needs_review_pages ARRAY<INT>, section_key STRING, section_title STRING, "
    "section_level INT, section_parent_keys ARRAY<STRING>, metadata STRING, api_context STRING"
)
PAGE = "doc_id STRING, page_no INT, primary_engine STRING, fallback_used BOOLEAN, ocr_confidence DOUBLE, layout_quality STRING, raw_text STRING, normalized_text STRING, needs_review BOOLEAN, metadata STRING"
QA_LOG = "id LONG, query STRING, summary STRING, citations ARRAY<STRING>, latency_ms INT, token_cost INT, created_at TIMESTAMP"

#: The tables of the store, by name. Later columns are those that were added to the first form.
TABLES = {
    "documents": "id LONG, title STRING, type STRING, source STRING, language STRING, year INT, authors ARRAY<STRING>, file_path STRING, hash STRING, ocr_status STRING, parse_status STRING, version STRING, created_at TIMESTAMP",
    "document_sections": "id LONG, doc_id LONG, parent_id LONG, heading STRING, level INT, page_start INT, page_end INT",
    "chunks": "id LONG, doc_id LONG, section_id LONG, page_start INT, page_end INT, chunk_type STRING, text STRING, normalized_text STRING, token_count INT, citation_anchor STRING",
    "figures_tables": "id LONG, doc_id LONG, page_no INT, kind STRING, caption STRING, image_path STRING, related_chunk_ids ARRAY<LONG>",
    "terms": "id LONG, canonical_term STRING, zh_name STRING, en_name STRING, aliases ARRAY<STRING>, notes STRING, topic STRING",
    "symbols": "id LONG, canonical_symbol STRING, latex STRING, meaning STRING, unit STRING, notes STRING, avoid_confusion_with ARRAY<STRING>",
    "units": "id LONG, quantity STRING, canonical_units STRING, aliases ARRAY<STRING>, warning_notes STRING",
    "citations": "id LONG, answer_id STRING, chunk_id LONG, evidence_type STRING, confidence FLOAT",
    "qa_logs": "id LONG, query STRING, intent STRING, chosen_skills ARRAY<STRING>, retrieved_chunks ARRAY<LONG>, final_verdict STRING, created_at TIMESTAMP",
}
ADDED = {
    "documents": "external_id STRING",
    "chunks": "external_id STRING, pages ARRAY<INT>, source_type STRING, topic STRING",
    "qa_logs": "status STRING, citations STRING, latency_ms INT, token_cost INT, supervisor_invocations INT",
}
#: Columns whose values are distinct where they are present.
UNIQUE = {"documents": ("hash", "external_id"), "chunks": ("external_id",), "terms": ("canonical_term",), "symbols": ("canonical_symbol",)}
#: Columns that are never null.
REQUIRED = {"documents": ("title", "file_path"), "chunks": ("text",), "terms": ("canonical_term",), "symbols": ("canonical_symbol",), "units": ("quantity", "canonical_units"), "citations": ("answer_id",), "qa_logs": ("query",)}
CASCADE, SET_NULL = "cascade", "set null"


class Reference(NamedTuple):
    """A column that holds ids of another table, and what becomes of a row when the row that it names goes."""

    table: str
    column: str
    target: str
    action: str


#: A table follows those that it refers to in the order of TABLES.
REFERENCES = (
    Reference("document_sections", "doc_id", "documents", CASCADE),
    Reference("document_sections", "parent_id", "document_sections", CASCADE),
    Reference("chunks", "doc_id", "documents", CASCADE),
    Reference("chunks", "section_id", "document_sections", SET_NULL),
    Reference("figures_tables", "doc_id", "documents", CASCADE),
    Reference("citations", "chunk_id", "chunks", CASCADE),
)
