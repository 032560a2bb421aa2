"""All queries of the core, and the SQL that says the same."""

from __future__ import annotations

from quire.plans import curation_queries, exchange_queries, graph_queries, measure_queries, orphan_queries, relational_queries, study_queries, text_queries, upkeep_queries, vocabulary_queries

MODULES = [orphan_queries, relational_queries, text_queries, graph_queries, vocabulary_queries, measure_queries, curation_queries, study_queries, upkeep_queries, exchange_queries]


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
