"""All queries of the library by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from tessera.plans import byte_queries, column_queries, line_queries, report_queries

PARTS = (line_queries, column_queries, byte_queries, report_queries)
QUERIES: dict = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE: dict = {name: sql for part in PARTS for name, sql in part.ORACLE.items()}
