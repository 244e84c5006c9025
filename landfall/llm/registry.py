"""Names of the queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import queries, sql

QUERIES = {name: getattr(queries, name) for name in dir(queries) if name.startswith("op")}
ORACLES = {name: getattr(sql, name) for name in dir(sql) if name.startswith("op")}
