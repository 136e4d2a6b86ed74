"""Every registered query with its SQL."""

from __future__ import annotations

from . import graph, history, library, lookups, retrieval, services, structure

_ALL = [lookups.R, structure.R, graph.R, retrieval.R, history.R, services.R, library.R]
QUERIES = {name: q for r in _ALL for name, q in r.queries.items()}
ORACLE_SQL = {name: sql for r in _ALL for name, sql in r.sql.items()}
