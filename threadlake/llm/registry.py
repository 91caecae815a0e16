"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from threadlake.llm import clusters, conversations, lookalike, packing, pii, sequences, tokens, vectors

_MODULES = [tokens, packing, lookalike, conversations, sequences, vectors, clusters, pii]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
