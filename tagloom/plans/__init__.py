"""Registered queries of the engine's own operators and the SQL that they are checked against."""

from __future__ import annotations

from . import analytics, collections, elements, entities, graph, kept, menus, pages, scalars, search

_MODULES = (search, scalars, collections, entities, graph, analytics, pages, menus, elements, kept)

QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
