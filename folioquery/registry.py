"""Queries of the document-analytics operators and their DuckDB counterparts."""

from __future__ import annotations

from folioquery.plans import assembly, canonical, checks, documents, lifecycle, packages, pages, payloads, planning, review, runs, structure, terms, tree

_MODULES = (documents, structure, terms, review, canonical, runs, pages, assembly, tree, planning, lifecycle, packages, checks, payloads)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
