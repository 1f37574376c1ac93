"""All queries of the core package by name, with the SQL that states the same result."""

from __future__ import annotations

from keystrata.plans import pipeline_queries, store_queries, table_queries

QUERIES = {**table_queries.QUERIES, **store_queries.QUERIES, **pipeline_queries.QUERIES}
ORACLE = {**table_queries.ORACLE, **store_queries.ORACLE, **pipeline_queries.ORACLE}
