"""Registered queries over the given tables, with their SQL."""

from __future__ import annotations

from . import queries_details, queries_faults, queries_landing, queries_panel, queries_runs, queries_ticks

MODULES = (queries_ticks, queries_panel, queries_landing, queries_details, queries_faults, queries_runs)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
