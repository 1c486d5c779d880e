"""Queries over the proxy views and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import driver_queries, ingest_queries, panel_queries, score_queries

QUERIES = driver_queries.QUERIES | score_queries.QUERIES | panel_queries.QUERIES | ingest_queries.QUERIES
ORACLE: dict[str, str] = driver_queries.ORACLE | score_queries.ORACLE | panel_queries.ORACLE | ingest_queries.ORACLE
