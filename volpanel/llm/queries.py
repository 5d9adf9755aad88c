"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import queries_chat, queries_decontaminate, queries_jaccard, queries_learned, queries_mixing, queries_negatives, queries_repair, queries_scan, queries_tokens, queries_vectors, queries_warc

MODULES = (queries_scan, queries_learned, queries_tokens, queries_decontaminate, queries_jaccard, queries_warc, queries_vectors, queries_chat, queries_negatives, queries_repair, queries_mixing)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
