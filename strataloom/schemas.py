"""Schemas of the tables that the library writes."""

from __future__ import annotations

DOCUMENT = (
    "document_id string, document_name string, sha256 string, format string, mime string, category string, size_bytes long, status string, uploaded_at timestamp, path string, error string, custom_metadata map<string,string>"
)
PAGE = "document_id string, document_name string, page_number int, text string, char_count int, word_count int"
CHUNK = "document_id string, document_name string, page_number int, chunk_id string, chunk_index int, text string, char_count int, word_count int"
SOURCE = "struct<document_id:string,document_name:string,page_number:int,chunk_id:string,source_text:string>"
ENTITY = f"name string, canonical_name string, type string, description string, aliases array<string>, source {SOURCE}, confidence double"
RELATIONSHIP = f"source_entity string, target_entity string, relationship_type string, description string, source {SOURCE}, weight double"
PROVENANCE = "struct<repository_url:string,repository_name:string,branch:string,commit_sha:string,file_path:string,start_line:int,end_line:int,source_snippet:string,extraction_method:string>"
VERTEX = "id string, label string, name string, description string, aliases string, repository_name string, repository_url string, branch string, commit_sha string, file_path string, start_line int, end_line int, source_snippet string, extraction_method string, confidence double, properties map<string,string>"
EDGE = "src string, label string, dst string, weight double, description string, repository_name string, commit_sha string, file_path string, start_line int, end_line int, extraction_method string"
STATUS = "document_id string, status string, updated_at timestamp, error string, custom_metadata map<string,string>"
RAW = "document_id string, document_name string, content binary"
SYNC = "synced_at timestamp, vertices_created long, vertices_existing long, edges_created long, edges_existing long"
STATUSES = ("UPLOADED", "EXTRACTING", "EXTRACTED", "GENERATING_CONTEXT", "BUILDING_GRAPH", "COMPLETED", "FAILED")
TIERS = ("raw", "metadata", "extracted_pages", "chunks", "context", "graph_sync")
