"""Queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from docloom.llm import decision_list, decontam, filter_audit, html_text, jaccard, langid, line_dedup, lm, mixing, quality, search, tokens, whitening

_MODULES = [mixing, decontam, quality, search, html_text, jaccard, line_dedup, lm, langid, tokens, whitening, decision_list, filter_audit]

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
