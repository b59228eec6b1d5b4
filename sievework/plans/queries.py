"""All registered queries of the library proper, and their SQL."""

from __future__ import annotations

from sievework.plans import queries_files, queries_metrics, queries_tables

_PARTS = (queries_metrics, queries_tables, queries_files)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
SQL = {name: q for part in _PARTS for name, q in part.SQL.items()}
