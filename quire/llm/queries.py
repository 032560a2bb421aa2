"""All queries of the subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from quire.llm import canonical_queries, consensus_queries, entity_queries, near_copy_queries, neighbour_queries, pair_queries, stuffing_queries, token_queries

MODULES = [pair_queries, consensus_queries, entity_queries, canonical_queries, near_copy_queries, neighbour_queries, token_queries, stuffing_queries]

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
