"""All queries of the core and their SQL."""

from __future__ import annotations

from papergrid.plans import composed, literature, training

_PARTS = (literature, composed, training)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
