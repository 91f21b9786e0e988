"""Schemas of the index's tables."""

from __future__ import annotations

FILES = "path string, mtime long, hash string, chunk_type string, error string, length long"
RAW = (
    "chunk_type string, name string, kind string, file string, seq int, line_start int, line_end int, byte_start long, byte_end long, "
    "content string, context string, signature string, doc_summary string, visibility string"
)
CHUNKS = "chunk_id long, " + RAW
EMBEDDINGS = "chunk_id long, embedding array<float>"
SUMMARIES = "key string, body_hash string, context_hash string, summary string"
VERSION = 2
