"""Schemas of the core records."""

from __future__ import annotations

DOCUMENTS = (
    "book_id bigint, slug string, title string, author string, num_chunks int, num_chars bigint, doc_type string, "
    "metadata string, added_at timestamp_ntz"
)

SECTION_SUMMARIES = "book_id bigint, chapter_id int, summary string, created_at timestamp_ntz"

DOCUMENT_SUMMARIES = "book_id bigint, summary string, created_at timestamp_ntz"

QUERY_METRICS = (
    "query_id string, timestamp timestamp_ntz, query string, response string, book_slug string, latency_ms double, "
    "success boolean, error_message string, tool_calls array<string>, num_results int, llm_relevance_score string, "
    "llm_reasoning string, user_rating int, user_comment string, retry_attempted boolean, original_query string, "
    "rephrased_query string, retry_results int, fallback_to_context boolean"
)

GOLDEN = "gold_id string, query string"

DOC_TYPES = ("book", "script", "conversation", "tech_doc", "report")
