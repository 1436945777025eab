"""All queries of the library by name, with the SQL that must give the same rows."""

from __future__ import annotations

from . import queries_ledger, queries_lifecycle, queries_patterns, queries_pieces, queries_similarity, queries_style

MODULES = (queries_style, queries_similarity, queries_patterns, queries_ledger, queries_lifecycle, queries_pieces)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
FLAGSHIP = "o083_slot_fingerprint"
