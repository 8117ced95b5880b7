"""All queries of the library and their SQL."""

from __future__ import annotations

from docgraph.plans import graph_queries, layout_queries, table_queries

_MODULES = [layout_queries, graph_queries, table_queries]
QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
