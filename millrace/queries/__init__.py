"""Registered queries over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from millrace.queries import dimensions, logs, metrics, scalars, snapshots, streams

_MODULES = (scalars, logs, metrics, snapshots, dimensions, streams)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}

flagship = logs.flagship
