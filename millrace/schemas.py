"""Explicit schemas of the engine's tables, and the defaults of missing values."""

from __future__ import annotations

BLOCK = "struct<block_id:string,type:string,text:string,bbox:array<double>,confidence:double>"
RECORDS = (
    "source string, filename string, rec_idx int, page_number int, location string, file_type string, content_type string, text string, "
    f"blocks array<{BLOCK}>, extraction_method string, ocr_used boolean, ocr_confidence double, section string, is_table boolean, "
    "requires_vision boolean, drawing_code string"
)
REGISTRY = (
    "document_id string, filename string, path string, file_hash string, file_type string, category string, document_type string, "
    "status string, created_at timestamp, updated_at timestamp, ocr_used int, chunk_count int"
)
EDGES = "src string, dst string, relation string, source string, seq long"
AUDIT = "timestamp timestamp, component string, operation string, target string, status string, is_local boolean, details string"
TURNS = "conv_id long, turn long, question string, answer string, sources array<string>"
EVAL_QUESTIONS = "question string, expected_keywords array<string>, category string"

#: What a missing value of a chunk means, in the order of the columns that a search gives back.
DEFAULTS = {
    "text": "", "source": "Unknown", "filename": "Unknown", "location": "Unknown", "page_number": 1, "section": None, "file_type": "unknown", "content_type": "document",
    "category": "general", "document_type": "general", "tags": [], "measurements": [], "ocr_used": False, "extraction_method": "native_text", "ocr_confidence": None,
    "parent_id": "", "parent_text": "", "citation": "",
}
#: Types of those that aren't strings.
PAYLOAD = {"page_number": "int", "tags": "array<string>", "measurements": "array<string>", "ocr_used": "boolean", "ocr_confidence": "double"}
