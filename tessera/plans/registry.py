"""Every query of the engine's own operators by name."""

from __future__ import annotations

from tessera.plans import connectors, intervals, relational, scalar, streams, user_functions, windows

_MODULES = (relational, windows, intervals, scalar, connectors, streams, user_functions)

QUERIES = {name: q for m in _MODULES for name, q in m.registry.queries.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.registry.sql.items()}
