"""Schemas of stored tables. Optional fields are null; display defaults are applied where text is made, never stored."""

from __future__ import annotations

DOC = (
    "doc_id STRING, page_content STRING, source_file STRING, source_type STRING, format STRING, equipment_type STRING, page_title STRING, breadcrumb_raw STRING, source_root STRING, source_url STRING, "
    "release_version STRING, library_name STRING, function_block_name STRING, keywords STRING, generated_questions STRING, next_file STRING, ord INT"
)
REFERENCE = "STRUCT<source_id: STRING, title: STRING, source_file: STRING, url: STRING, source_type: STRING, page_title: STRING, release_version: STRING, equipment_type: STRING, library_name: STRING, breadcrumb: STRING>"
RESPONSE = (
    "user_intent STRING, docs_answer STRING, related_topics ARRAY<STRING>, similar_tickets ARRAY<STRUCT<ticket_id: STRING, problem_summary: STRING, solution_summary: STRING>>, "
    "evidence_notes ARRAY<STRUCT<claim: STRING, source_ids: ARRAY<STRING>, comment: STRING>>, recommended_questions ARRAY<STRING>, internal_notes ARRAY<STRING>, missing_context STRING, "
    "draft_private_comment STRING, confidence STRING"
)
REGISTRY = "source_type STRING, path STRING, hash STRING, parent_ids ARRAY<STRING>"
