"""All registered queries of the engine, and the SQL beside them."""

from __future__ import annotations

from . import capture_queries, graph_queries, ingest_queries, queries  # noqa: F401 (each registers its own)

QUERIES, SQL = queries.QUERIES, queries.SQL
