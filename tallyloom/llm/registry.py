"""The queries of this folder and the SQL for those that SQL can express."""

from __future__ import annotations

from tallyloom.llm import queries_chat, queries_codes, queries_language, queries_minhash, queries_mixing, queries_packing, queries_pages, queries_pii, queries_quality, queries_toxicity, queries_turns, queries_vectors

_parts = (queries_vectors, queries_pii, queries_chat, queries_pages, queries_packing, queries_mixing, queries_toxicity, queries_minhash, queries_quality, queries_language, queries_turns, queries_codes)

QUERIES = {name: query for part in _parts for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _parts for name, sql in part.ORACLES.items()}
