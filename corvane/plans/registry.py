"""All queries of the library outside the training-data subpackage, by name, with their SQL."""

from __future__ import annotations

from corvane.plans import call_queries, ingest_queries, other_queries, record_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (call_queries, record_queries, ingest_queries, other_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
